import numpy as np

from planted import as_counts
from tallymix.operators.cells import prepare
from tallymix.operators.initial import Start, init_kmeans, kmeans
from tallymix.workspace import Workspace


def labels(data, start):
    got = kmeans(data, [start], n_init=1, max_iter=1).collect()
    return {r.sample_id: r.label for r in got}


def test_another_seed_gives_another_start(small):
    _, _, data = small
    found = [labels(data, Start(0, 3, seed)) for seed in (1, 2, 3, 4)]
    assert any(x != found[0] for x in found)


def test_a_start_does_not_depend_on_the_number_of_its_model(small):
    _, _, data = small
    assert labels(data, Start(0, 3, 5)) == labels(data, Start(7, 3, 5))
    among = kmeans(data, [Start(1, 3, 5), Start(2, 2, 9)], n_init=1, max_iter=1).where("model_id = 1").collect()
    assert {r.sample_id: r.label for r in among} == labels(data, Start(0, 3, 5))


def test_fewer_samples_than_groups(spark):
    x = np.array([[5.0, 0, 1], [0, 4.0, 2]])
    data = prepare(as_counts(spark, x), Workspace(spark))
    rows = {r.sample_id: r.r for r in init_kmeans(data, [Start(0, 4, 3)], n_init=2, max_iter=4).collect()}
    assert len(rows) == 2 and all(len(r) == 4 and sum(r) == 1.0 for r in rows.values()) and rows[0] != rows[1]
