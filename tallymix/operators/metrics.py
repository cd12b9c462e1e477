"""Agreement, quality and selection scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.functions.special import hash_uniform, num
from tallymix.operators.cells import CountData, sums_by_feature, sums_by_sample
from tallymix.operators.likelihood import unfold


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair counts of two labelings ``(sample_id, label)``: ``a, b, n``."""
    left, right = a.selectExpr("sample_id", "label as a"), b.selectExpr("sample_id", "label as b")
    return left.join(right, "sample_id").groupBy("a", "b").agg(F.count("*").alias("n"))


def _margins(pairs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Sums of ``value(n)`` over cells, rows, columns and the total, one row per key."""
    parts = None
    for name, cols in (("cell", ["a", "b"]), ("row", ["a"]), ("col", ["b"]), ("whole", [])):
        counted = pairs.groupBy(*keys, *cols).agg(F.sum("n").alias("n"))
        part = counted.groupBy(*keys).agg(
            F.expr(f"sum({value}) as s"), F.expr("cast(count(*) as double) as c"), F.expr("cast(sum(n) as double) as total")
        ).selectExpr(*keys, f"'{name}' as part", "s", "c", "total")
        parts = part if parts is None else parts.unionByName(part)
    picked = [
        F.expr(f"max(if(part = '{name}', {col}, null)) as {out}")
        for name, col, out in (
            ("cell", "s", "s_cell"), ("row", "s", "s_row"), ("col", "s", "s_col"), ("whole", "s", "s_all"),
            ("row", "c", "c_row"), ("col", "c", "c_col"), ("whole", "total", "n_all"),
        )
    ]
    return parts.groupBy(*keys).agg(*picked)


_COMB2 = "cast(n as double) * (n - 1) / 2D"


def ari_from_contingency(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index; 1 where both labelings are trivial in the same way."""
    keys = keys or []
    m = _margins(pairs, _COMB2, keys)
    expected, most = "s_row * s_col / s_all", "(s_row + s_col) / 2D"
    value = f"if(s_all = 0 or {most} = {expected}, 1D, (s_cell - {expected}) / ({most} - {expected}))"
    guarded = f"if(n_all < 2, 1D, {value})"
    return m.selectExpr(*keys, f"{guarded} as ari")


def ari(a: DataFrame, b: DataFrame) -> DataFrame:
    return ari_from_contingency(contingency(a, b))


def nmi_from_contingency(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mutual information over the arithmetic mean of both entropies; 1 for two trivial labelings."""
    keys = keys or []
    m = _margins(pairs, "n * ln(n)", keys)
    h = lambda s: f"(ln(n_all) - {s} / n_all)"
    mi = f"greatest({h('s_row')} + {h('s_col')} - {h('s_cell')}, 0D)"
    mean = f"(({h('s_row')} + {h('s_col')}) / 2D)"
    value = f"case when c_row = 1 and c_col = 1 then 1D when c_row = 1 or c_col = 1 then 0D else {mi} / {mean} end"
    return m.selectExpr(*keys, f"{value} as nmi")


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    return nmi_from_contingency(contingency(a, b))


def confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts and row shares for every pair of labels, zero-filled."""
    pairs = contingency(a, b)
    predicted = [r[0] for r in pairs.select("b").distinct().orderBy("b").collect()]  # one row per label
    grid = pairs.select("a").distinct().withColumn("b", F.explode(F.array(*[F.lit(v) for v in predicted])))
    filled = grid.join(pairs, ["a", "b"], "left").selectExpr("a", "b", "coalesce(n, 0L) as n")
    share = "if(sum(n) over (partition by a) = 0, 0D, n / sum(n) over (partition by a)) as share"
    return filled.selectExpr("a", "b", "n", share)


def size_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of both labelings by label id from 0 to the largest; missing ids count 0."""
    sa = a.groupBy("label").agg(F.count("*").alias("n_true"))
    sb = b.groupBy("label").agg(F.count("*").alias("n_predicted"))
    top = a.select("label").unionAll(b.select("label")).agg(F.max("label")).first()[0]
    ids = a.sparkSession.range(0, 0 if top is None else int(top) + 1).selectExpr("cast(id as int) as label")
    sized = ids.join(sa, "label", "left").join(sb, "label", "left")
    return sized.selectExpr("label", "coalesce(n_true, 0L) as n_true", "coalesce(n_predicted, 0L) as n_predicted")


def quality_proxy(resp: DataFrame, width: int) -> DataFrame:
    """Label-free quality per model: mean of confidence, sharpness and balance."""
    staged = resp.selectExpr(
        "model_id", "size(r) as k", "array_max(r) as peak",
        f"aggregate(r, 0D, (acc, v) -> acc - v * ln(v + {num(1e-10)})) as h", *unfold("r", "r", width),
    )
    sums = staged.groupBy("model_id").agg(
        F.first("k").alias("k"), F.count("*").alias("n"), F.avg("peak").alias("confidence"), F.avg("h").alias("h"),
        *[F.expr(f"sum(r{k}) as m{k}") for k in range(width)],
    )
    sizes = f"slice(array({', '.join(f'm{k} / (n + 1e-10D)' for k in range(width))}), 1, k)"
    sums = sums.withColumn("sizes", F.expr(sizes))
    sums = sums.withColumn("mean", F.expr("aggregate(sizes, 0D, (a, v) -> a + v) / k"))
    sums = sums.withColumn("sd", F.expr("sqrt(aggregate(sizes, 0D, (a, v) -> a + (v - mean) * (v - mean)) / k)"))
    out = sums.selectExpr(
        "model_id", "confidence", "1D - h / ln(greatest(k, 2)) as sharpness",
        "least(greatest(1D - sd * sqrt(k), 0D), 1D) as balance",
    )
    return out.selectExpr("*", "(confidence + sharpness + balance) / 3D as quality")


def selection_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives, precision, recall and F1 of a set of features."""
    f = found.select("feature_id").distinct().withColumn("f", F.lit(1))
    t = truth.select("feature_id").distinct().withColumn("t", F.lit(1))
    sums = f.join(t, "feature_id", "full").agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("f").isNotNull() & F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("f").isNull() & F.col("t").isNotNull()).alias("fn"),
    )
    rates = sums.selectExpr("*", "tp / greatest(tp + fp, 1) as precision", "tp / greatest(tp + fn, 1) as recall")
    return rates.selectExpr("*", "2D * precision * recall / greatest(precision + recall, 1e-10D) as f1")


# Bands of the adjusted Rand index and their names.
VERDICTS = ((0.8, "excellent"), (0.6, "good"), (0.4, "fair"))


def verdict(scores: DataFrame, column: str = "ari") -> DataFrame:
    name = F.lit("poor")
    for level, word in reversed(VERDICTS):
        name = F.when(F.col(column) >= level, F.lit(word)).otherwise(name)
    return scores.withColumn("verdict", name)


def label_agreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adjusted Rand index and share of equal values for every pair of label columns."""
    pairs = [(p, q) for i, p in enumerate(columns) for q in columns[i + 1:]]
    rows = ", ".join(
        f"struct('{p}' as label_a, '{q}' as label_b, cast(`{p}` as string) as a, cast(`{q}` as string) as b)" for p, q in pairs
    )
    counted = df.selectExpr(f"inline(array({rows}))").groupBy("label_a", "label_b", "a", "b").agg(F.count("*").alias("n"))
    keys = ["label_a", "label_b"]
    equal = counted.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.expr("sum(if(a = b, n, 0)) as n_equal")
    )
    return equal.join(ari_from_contingency(counted, keys), keys).selectExpr(
        *keys, "n", "n_equal", "n_equal / n as share_equal", "ari"
    )


# --- silhouette -------------------------------------------------------------------------


def silhouette_squared(data: CountData, labels: DataFrame, log1p: bool = True) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, in time linear in the cells; 0 for fewer than two groups.

    The mean squared distance to a group follows from its size, its sum vector and its
    sum of squared norms, so no pair of samples is formed.
    """
    value = "log1p(x)" if log1p else "x"
    ids = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()]  # one row per group
    if len(ids) < 2:
        return data.spark.range(1).selectExpr("0D as silhouette")
    coded = labels.selectExpr("sample_id", _code("label", ids) + " as g")
    cells = data.cells.withColumn("v", F.expr(value))
    width = len(ids)
    marked = data.with_samples(cells, coded)
    centers = sums_by_feature(marked, [F.expr(f"sum(if(g = {k}, v, 0D)) as c{k}") for k in range(width)], ())
    norms = cells.groupBy("sample_id").agg(F.expr("sum(v * v) as sq"))
    points = coded.join(norms, "sample_id", "left").selectExpr("sample_id", "g", "coalesce(sq, 0D) as sq")
    groups = points.agg(
        *[F.expr(f"cast(count_if(g = {k}) as double) as n{k}") for k in range(width)],
        *[F.expr(f"coalesce(sum(if(g = {k}, sq, 0D)), 0D) as q{k}") for k in range(width)],
    ).first()  # two numbers per group
    joined = data.with_features(cells, centers, width)
    dots = sums_by_sample(joined, [F.expr(f"sum(v * c{k}) as d{k}") for k in range(width)], ())
    rows = points.join(dots, "sample_id", "left")
    total = ", ".join(
        f"{num(groups[f'n{k}'])} * sq - 2D * coalesce(d{k}, 0D) + {num(groups[f'q{k}'])}" for k in range(width)
    )
    sizes = ", ".join(num(groups[f"n{k}"]) for k in range(width))
    rows = rows.selectExpr("sample_id", "g", f"array({total}) as total", f"array({sizes}) as sizes")
    return _silhouette(rows)


def _code(column: str, values: list) -> str:
    cases = " ".join(f"when {column} = {_literal(v)} then {i}" for i, v in enumerate(values))
    return f"case {cases} end"


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def _silhouette(rows: DataFrame) -> DataFrame:
    """Mean silhouette from ``g``, and per group the total distance and the size."""
    a = "get(total, g) / greatest(get(sizes, g) - 1D, 1D)"
    others = "transform(total, (t, i) -> if(i = g or get(sizes, i) = 0, cast(null as double), t / get(sizes, i)))"
    staged = rows.selectExpr("g", "sizes", f"{a} as a", f"array_min({others}) as b")
    score = "if(get(sizes, g) <= 1 or greatest(a, b) = 0, 0D, (b - a) / greatest(a, b))"
    return staged.selectExpr(f"{score} as s").agg(F.avg("s").alias("silhouette"))


def silhouette(data: CountData, labels: DataFrame, log1p: bool = True, block: int = 2048) -> DataFrame:
    """Exact mean silhouette under Euclidean distance; 0 for fewer than two groups. Samples without cells count as zeros.

    Euclidean distances need every pair of samples, so the work grows with N squared;
    ``silhouette_squared`` is the linear-time number for large tables. Samples are
    hashed into blocks; a task holds two blocks at a time and returns only the summed
    distances per sample and group, never pairs.
    """
    value = "log1p(x)" if log1p else "x"
    ids = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()]
    if len(ids) < 2:
        return data.spark.range(1).selectExpr("0D as silhouette")
    width, blocks = len(ids), max(1, math.ceil(data.n_samples / block))
    coded = labels.selectExpr("sample_id", _code("label", ids) + " as g", f"pmod(xxhash64(sample_id), {blocks}) as block")
    sizes = {r["g"]: r["n"] for r in coded.groupBy("g").agg(F.count("*").alias("n")).collect()}
    # one row per (sample, other block) holds a sample's cells as arrays
    vectors = data.cells.groupBy("sample_id").agg(
        F.collect_list(F.struct(F.xxhash64("feature_id").alias("f"), F.expr(value).alias("v"))).alias("cells")
    )
    vectors = coded.join(vectors, "sample_id", "left").selectExpr(
        "block", "sample_id", "g", "coalesce(cells, array()) as cells")
    vectors = data.ws.put(vectors, "silhouette-vectors")
    left = vectors.selectExpr("block as bi", f"explode(sequence(0, {blocks - 1})) as bj", "true as own", "*")
    right = vectors.selectExpr(f"explode(sequence(0, {blocks - 1})) as bi", "block as bj", "false as own", "*")
    both = left.unionByName(right).drop("block")
    id_type = data.samples.schema["sample_id"].dataType.simpleString()

    def kernel(key, pdf):
        import pandas as pd

        own, other = pdf[pdf["own"]], pdf[~pdf["own"]]
        if own.empty or other.empty:
            return pd.DataFrame({"sample_id": [], "g": [], "total": []})
        index: dict[int, int] = {}
        a, b = _dense(own["cells"], index), _dense(other["cells"], index)
        a = np.pad(a, ((0, 0), (0, len(index) - a.shape[1])))
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
        dist = np.sqrt(np.maximum(d2, 0.0))
        if key[0] == key[1]:
            same = own["sample_id"].to_numpy()[:, None] == other["sample_id"].to_numpy()[None, :]
            dist[same] = 0.0
        hot = np.zeros((len(other), width))
        hot[np.arange(len(other)), other["g"].to_numpy()] = 1.0
        return pd.DataFrame({"sample_id": own["sample_id"].to_numpy(), "g": own["g"].to_numpy(), "total": list(dist @ hot)})

    parts = both.groupBy("bi", "bj").applyInPandas(kernel, f"sample_id {id_type}, g int, total array<double>")
    flat = parts.selectExpr("sample_id", "g", *unfold("total", "t", width))
    sums = flat.groupBy("sample_id", "g").agg(*[F.expr(f"sum(t{k}) as t{k}") for k in range(width)])
    listed = ", ".join(num(sizes.get(k, 0)) for k in range(width))
    rows = sums.selectExpr("g", f"array({', '.join(f't{k}' for k in range(width))}) as total", f"array({listed}) as sizes")
    return _silhouette(rows)


def _dense(cells, index: dict[int, int]) -> np.ndarray:
    """Rows of (feature, value) lists as a dense block; features get columns as they appear."""
    rows, cols, vals = [], [], []
    for i, row in enumerate(cells):
        for c in row:
            cols.append(index.setdefault(c["f"], len(index)))
            rows.append(i)
            vals.append(c["v"])
    out = np.zeros((len(cells), len(index)))
    out[rows, cols] = vals
    return out


# --- projection -------------------------------------------------------------------------


def project_2d(data: CountData, seed: int = 0, oversample: int = 4, iterations: int = 6) -> DataFrame:
    """First two principal components of the log1p rows: ``sample_id, pc1, pc2``.

    Subspace iteration over the cells: sums by sample give scores, sums by feature give
    new directions, centring is a rank-one correction. Only matrices as small as the
    subspace reach the driver.
    """
    ws, w, n = data.ws, 2 + oversample, float(data.n_samples)
    cells = data.cells.withColumn("v", F.log1p("x"))
    means = cells.groupBy("feature_id").agg(F.expr(f"sum(v) / {num(n)} as mu"))
    start = [f"{hash_uniform('feature_id', str(k), seed=seed)} - 0.5D as q{k}" for k in range(w)]
    basis = ws.put(means.selectExpr("feature_id", "mu", *start), "basis")

    def rotate(table: DataFrame, m: np.ndarray) -> DataFrame:
        mixed = [" + ".join(f"q{j} * {num(m[j, k])}" for j in range(w)) + f" as q{k}" for k in range(m.shape[1])]
        return table.selectExpr("feature_id", "mu", *mixed)

    def small(table: DataFrame, prefix: str) -> np.ndarray:
        pairs = [(i, j) for i in range(w) for j in range(i, w)]
        row = table.agg(*[F.expr(f"sum({prefix}{i} * {prefix}{j}) as g{i}_{j}") for i, j in pairs]).first()
        g = np.zeros((w, w))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
        return g

    def orthonormal(g: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(g)
        return vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-300)))

    def scores(table: DataFrame) -> DataFrame:
        shift = table.agg(*[F.expr(f"sum(mu * q{k}) as m{k}") for k in range(w)]).first()
        joined = data.with_features(cells, table.drop("mu"), w)
        raw = sums_by_sample(joined, [F.expr(f"sum(v * q{k}) as s{k}") for k in range(w)], ())
        raw = data.samples.select("sample_id").join(raw, "sample_id", "left")
        return raw.selectExpr(
            "sample_id", *[f"coalesce(s{k}, 0D) - {num(shift[f'm{k}'])} as s{k}" for k in range(w)]
        )

    for _ in range(iterations):
        table = rotate(basis, orthonormal(small(basis, "q")))
        per_sample = ws.put(scores(table), "scores")
        total = per_sample.agg(*[F.expr(f"sum(s{k}) as t{k}") for k in range(w)]).first()
        sums = sums_by_feature(
            data.with_samples(cells, per_sample), [F.expr(f"sum(v * s{k}) as z{k}") for k in range(w)], ()
        )
        old = basis
        basis = ws.put(
            basis.select("feature_id", "mu").join(sums, "feature_id").selectExpr(
                "feature_id", "mu", *[f"z{k} - mu * {num(total[f't{k}'])} as q{k}" for k in range(w)]), "basis")
        ws.release(old, per_sample)
    table = ws.put(rotate(basis, orthonormal(small(basis, "q"))), "basis")
    per_sample = ws.put(scores(table), "scores")
    _, vectors = np.linalg.eigh(small(per_sample, "s"))
    first, second = vectors[:, -1], vectors[:, -2]
    mix = lambda v: " + ".join(f"s{k} * {num(v[k])}" for k in range(w))
    return per_sample.selectExpr("sample_id", f"{mix(first)} as pc1", f"{mix(second)} as pc2")


def metrics_row(ari_row: DataFrame, nmi_row: DataFrame, silhouette_row: DataFrame, elapsed: float, k: int) -> DataFrame:
    """All scores of one run as one record."""
    tagged = [df.selectExpr(f"'{name}' as name", f"cast({name} as double) as v")
              for name, df in (("ari", ari_row), ("nmi", nmi_row), ("silhouette", silhouette_row))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    scores = rows.agg(*[F.expr(f"max(if(name = '{n}', v, null)) as {n}") for n in ("ari", "nmi", "silhouette")])
    return scores.select("*", F.lit(float(elapsed)).alias("elapsed"), F.lit(int(k)).alias("k_estimated"))
