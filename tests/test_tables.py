"""Readers, preparation, layout, and a sample of registered queries against DuckDB."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import queries as registered
from checks.compare import difference, oracle
from planted import as_counts, as_labels, planted
from tallymix.operators import prep
from tallymix.operators.cells import prepare
from tallymix.operators.profiles import cluster_sums
from tallymix.sources import read_counts, tip_rows, validate_counts
from tallymix.workspace import Workspace

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["counts_from_tokens", "read_counts_wide", "tree_tips", "annotate_tips", "elog_sticks", "sweep_dp_memberships",
          "sweep_py_selection", "sweep_ssl_excess_profiles", "predict_mfm", "stochastic_profiles", "label_agreement",
          "mini_batch", "mask_cells", "init_random", "merge_weighted",
          "silhouette_exact", "running_best", "encode_labels", "signatures_per_sample", "metrics_row",
          "fit_ssl_excess"]  # a whole fit: frozen level, averaging, pruning, its own stop


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query(spark, con, name):
    ours = entry.queries()[name](spark, SMALL).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None
    if len(theirs):
        assert difference(ours, theirs.iloc[1:]) is not None  # the comparison does see a missing row


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_both_layouts_of_a_wide_table_read_the_same(spark, tmp_path):
    x, _ = planted(n=6, s=5, draws=20)
    names = ["a b", "c#1", "d.2", "e", "f"]
    by_sample = "\n".join(["id," + ",".join(names)] + [f"s{i}," + ",".join(map(str, x[i])) for i in range(6)])
    by_feature = "\n".join(["id\t" + "\t".join(f"s{i}" for i in range(6))] + [
        f"{names[j]}\t" + "\t".join(map(str, x[:, j])) for j in range(5)])
    (tmp_path / "a.csv").write_text(by_sample)
    (tmp_path / "b.tsv").write_text(by_feature)
    a = read_counts(spark, str(tmp_path / "a.csv")).orderBy("sample_id", "feature_id").collect()
    b = read_counts(spark, str(tmp_path / "b.tsv"), "\t", features_in_rows=True).orderBy("sample_id", "feature_id").collect()
    assert a == b and len(a) == np.count_nonzero(x)
    assert {r["feature_id"] for r in a} <= set(names)


def test_tips_in_order(spark):
    lines = spark.createDataFrame([("((A_1:0.1,b.2:2)0.9:0.3,(C:1,D_x:0.5):0.2);",)], "value string")
    assert [(r["tip_index"], r["tip"]) for r in tip_rows(lines).collect()] == [(1, "A_1"), (2, "b.2"), (3, "C"), (4, "D_x")]


def test_invalid_counts_are_refused(spark):
    bad = spark.createDataFrame([(1, "a", -1.0), (1, "b", 2.0), (1, "b", 2.0)], "sample_id int, feature_id string, x double")
    row = validate_counts(bad).first()
    assert (row["negative"], row["duplicates"]) == (1, 1)
    with pytest.raises(ValueError):
        validate_counts(bad, raise_errors=True)
    with pytest.raises(ValueError):
        prepare(bad, Workspace(spark))


def test_hot_keys_are_spread_and_sums_stay_whole(spark):
    """One sample and one feature hold most cells; no slice holds more than its share."""
    rows = [(0, f"f{j}", 1.0) for j in range(3000)] + [(i, "f0", 2.0) for i in range(1, 2500)]
    counts = spark.createDataFrame(rows, "sample_id bigint, feature_id string, x double")
    data = prepare(counts, Workspace(spark), slice_rows=500, bucket_rows=1000)
    assert data.sample_key == ["sample_id", "s_slice"] and data.feature_key == ["feature_id", "f_slice"]
    largest = data.cells.groupBy(*data.sample_key).count().agg(F.max("count")).first()[0]
    assert largest < 650 and data.cells.groupBy(*data.feature_key).count().agg(F.max("count")).first()[0] < 650
    resp = data.samples.selectExpr("0 as model_id", "sample_id", "array(0.25D, 0.75D) as r")
    sums = {r["feature_id"]: r["rx"] for r in cluster_sums(data, resp, 2).collect()}
    assert len(sums) == 3000 and sums["f0"] == pytest.approx([4999 * 0.25, 4999 * 0.75])
    table = data.features.selectExpr("feature_id", "colsum")
    data.broadcast_bytes = 0
    joined = data.with_features(data.cells, table, 1)
    assert joined.count() == data.nnz == len(rows)


def test_a_pass_moves_no_cells(spark, small):
    """Cells stay where they are on disk: only memberships and partial sums are exchanged."""
    _, _, data = small
    resp = data.samples.selectExpr("cast(0 as int) as model_id", "sample_id", "array(0.5D, 0.5D) as r")
    plan = cluster_sums(data, data.ws.put(resp, "resp"), 2)._jdf.queryExecution().executedPlan().toString()
    above_scan = plan.split("tallymix_")[0]
    assert "Bucketed: true" in plan and above_scan.count("Exchange") == 1  # that of the partial sums


def test_a_bucketed_write_opens_writers_instead_of_sorting(spark, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, rows = spark.conf.get(name), spark.range(64).selectExpr("id % 5 as key", "id").repartition(4, "key")
    save = DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable",
                        lambda self, *a, **k: seen.append(int(spark.conf.get(name))) or save(self, *a, **k))
    out = Workspace(spark).put(rows, "by-key", bucket_by=["key"], buckets=4)
    assert seen and seen[0] > 0 and spark.conf.get(name) == before
    assert sorted(out.collect()) == sorted(rows.collect())


def test_tip_marks_need_one_pass_over_the_counts(spark, tmp_path, monkeypatch):
    """The counts are read once; what the annotation joins afterwards holds one row per feature."""
    (spark.createDataFrame([(1, "de", "haus Tor"), (2, "fr", "tor mer"), (3, None, "sea"), (3, "fr", None), (None, "de", "lost")],
                           "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet"))
    calls, counted = [], registered.doc_token
    monkeypatch.setattr(registered, "doc_token", lambda *a: calls.append(a) or counted(*a))
    out = registered._annotated(spark, str(tmp_path))
    assert len(calls) == 1 and "documents.parquet" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("haus", "+"), ("tor", "*"), ("mer", "*"), ("sea", "*"), ("lost", "")}


def test_codes_of_many_labels(spark):
    labels = spark.createDataFrame([(i, f"l{(i * 7919) % 997}") for i in range(2000)], "sample_id bigint, label string")
    codes = {}
    for i in range(2000):
        codes.setdefault(f"l{(i * 7919) % 997}", len(codes))
    rows = prep.encode_labels(labels, "sample_id").collect()
    assert all(r["label_id"] == codes[r["label"]] for r in rows) and len(rows) == 2000
    assert prep.encode_labels(labels.limit(0), "sample_id").count() == 0


def test_masks_and_batches_are_repeatable(spark):
    x, _ = planted(n=40, s=20)
    counts = as_counts(spark, x)
    kept = prep.mask_cells(counts, 0.3, seed=4)
    assert sorted(kept.collect()) == sorted(prep.mask_cells(counts.repartition(3), 0.3, seed=4).collect())
    share = kept.count() / counts.count()
    assert 0.6 < share < 0.8
    samples = as_labels(spark, np.zeros(40))
    ws = Workspace(spark)
    order = prep.shuffled_places(samples, 5, ws)
    places = {r["sample_id"]: r["place"] for r in order.collect()}
    assert sorted(places.values()) == list(range(40))
    again = prep.shuffled_places(samples.repartition(7), 5, ws)
    assert places == {r["sample_id"]: r["place"] for r in again.collect()}
    assert places != {r["sample_id"]: r["place"] for r in prep.shuffled_places(samples, 6, ws).collect()}
    draws = [sorted(prep.mini_batch(order, 40, 10, t, 5).collect()) for t in (1, 2, 1)]
    assert len(set(draws[0])) == 10 and draws[0] == draws[2] != draws[1]
    assert sorted(r[0] for t in (1,) for r in prep.mini_batch(order, 40, 99, t, 5).collect()) == list(range(40))
    assert prep.shuffled_places(samples.limit(0), 5, ws).count() == 0 and prep.batch_window(0, 10, 1, 5) == []
    met = {r[0] for t in range(60) for a, b in prep.batch_window(40, 10, t, 5) for r in places.items() if a <= r[1] < b}
    assert len(met) == 40
