import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallymix.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = [row[c] for c in merkle.FIELDS]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(nodes, fan):
    """(root, siblings of each leaf from below), by whole levels."""
    proofs, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[i:i + fan], own[i:i + fan]) for i in range(0, len(nodes), fan)]
        for digests, members in runs:
            for j, m in enumerate(members):
                for leaf in m:
                    proofs[leaf] += digests[:j] + digests[j + 1:]
        nodes, own = [h("".join(d)) for d, _ in runs], [sum(m, []) for _, m in runs]
    return nodes[0], proofs


def brute(rows, fan):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256)."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang),
                     key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append((own, *tree([leaf_of(r) for r in own], fan)))
    root, above = tree([t[1] for t in trees], fan)
    return sorted(str((r["doc_id"], leaf_of(r), sub, root, h("".join(p + top))))
                  for (own, sub, proofs), top in zip(trees, above) for r, p in zip(own, proofs))


def result(rows):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in rows)


@pytest.fixture(scope="module")
def messy(odd, corpus):
    langs = F.when(F.col("doc_id") % 3 == 0, F.lit("é")).when(F.col("doc_id") % 3 == 1, F.lit("zz"))
    extra = odd.withColumn("lang", langs).withColumn("n_chars", F.length("text")).select(*merkle.FIELDS)
    return extra.union(corpus.select(*merkle.FIELDS)).withColumn("tree", F.lit(1)).withColumn("pos", F.lit("x"))


@pytest.mark.parametrize("fan, stretch", [(2, 4096), (2, 4), (3, 9), (5, 2)])
def test_manifest_equals_whole_levels(messy, fan, stretch):
    found = merkle.manifest(messy, fan=fan, stretch=stretch)
    assert result(found.collect()) == brute([r.asDict() for r in messy.collect()], fan)


def test_altered_rows_are_found(messy):
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.verify(merkle.manifest(messy, {"n_chars": F.col("n_chars") + F.when(altered, 1).otherwise(0)}))
    rows = {(r.doc_id, r.n_chars) for r in messy.collect()}
    changed = {d for d, n in rows if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0}
    kept = {d for d, n in rows if n is None}
    assert changed
    for r in found.collect():
        assert r.verified == (r.folded_root == r.root)
        assert r.verified == (r.doc_id not in changed) or r.doc_id in kept


def test_one_row_and_no_rows(spark, empty):
    one = spark.createDataFrame([(2**60 + 1, None, None, None, None)], empty.schema)
    row = merkle.verify(merkle.manifest(one)).first()
    assert row.doc_id == 2**60 + 1 and row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == h("") and row.leaf == h("19:1152921504606846977----")
    assert merkle.verify(merkle.manifest(empty)).count() == 0


def test_one_language_with_many_repeated_rows(spark):
    docs = spark.range(2000).selectExpr("if(id < 1500, 7, id) as doc_id", "'same' as text", "'en' as lang",
                                        "'web' as source", "4L as n_chars")
    found = merkle.verify(merkle.manifest(docs, stretch=64)).collect()
    assert all(r.verified for r in found) and result(found) == brute([r.asDict() for r in docs.collect()], 2)


def test_a_stretch_is_all_that_is_held():
    nodes = merkle.time_forward([h(str(i)) for i in range(11)], 2, 4)
    assert [n[:2] for n in nodes] == sorted(n[:2] for n in nodes) and nodes[-1][:2] == (4, 0)
    for i, path in enumerate(merkle.sweep_back(nodes, 2, "|;")):
        assert merkle.fold(h(str(i)), path) == h(nodes[-1][2])
