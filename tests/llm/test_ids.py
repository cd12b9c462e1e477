"""Ids above 2**53 beside a null one."""

import numpy as np
from pyspark.sql import functions as F

from tallymix.llm import attribution, bitpack, line_crf, ngram_join, packing, resampling, sanitise, tokens


def test_large_ids_beside_a_null(spark, tmp_path):
    base = (1 << 60) + 1
    text = "one two three four five six seven eight nine ten"
    rows = [(base + 2 * i, f"{text} {i % 10}", "a") for i in range(20)] + [(None, "a.b@example.org without an id", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    want = {r[0] for r in rows}
    near = {r.doc_id: r.component_id for r in ngram_join.near_groups(docs, n=2, num=99, den=100).collect()}
    assert near == {d: None if d is None else base + (d - base) % 20 for d in want}
    whole = attribution.attribute(docs, attribution.title_lead_body(F.col("text")))
    found = [whole, packing.pack(docs), line_crf.judge(docs, line_crf.LineModel()), sanitise.find(docs),
             resampling.resample(docs, np.zeros(1 << 10), 0.5)]
    path = str(tmp_path / "files")
    bitpack.write_tokens(docs, path, tokens.public_path())
    found.append(bitpack.read_digests(spark, path))
    for df in found:
        assert dict(df.dtypes)["doc_id"] == "bigint" and {r.doc_id for r in df.collect()} == want
    assert {r.doc_id for r in bitpack.read_documents(spark, path, [base, base + 4]).collect()} == {base, base + 4}
