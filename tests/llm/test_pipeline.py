"""Every stage of the pipeline against loops over the rows it gets."""
import hashlib
from collections import Counter

import corpus_pipeline
from tallymix.llm import line_crf
from tallymix.llm.common import ascii_lower, documents
from tallymix.workspace import Workspace
from test_groups import brute_targets
from test_ngram_join import brute
from test_tokens import packed_right

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, ws = documents(spark, SF), Workspace(spark)
    columns = docs.schema
    model = line_crf.train(docs, documents(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = ws.put(stage(spark, docs, SF), name)
        got = out.collect()
        if name == "packing":
            return packed_right(rows, got, 2048)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in columns]
        if name == "quality_rules":
            want = [r for r in rows if line_crf._verdict(r.text, model, 0.5)[6]]
        elif name == "exact_dedup":
            last = {}
            for r in rows:
                key = hashlib.sha256(ascii_lower(r.text or "").encode()).digest()
                last[key] = max(last.get(key, r), r, key=lambda x: x.doc_id)
            want = list(last.values())
        elif name == "ngram_join":
            stay = {d for d, _, c in brute(rows, 5, 80, 100) if d == c}
            want = [r for r in rows if r.doc_id in stay]
        else:
            sizes, taken = Counter(), Counter()
            for r in rows:
                sizes[r.source] += len(r.text.split())
            for r in got:
                taken[r.source] += len(r.text.split())
            target = brute_targets(sizes, (5, 2, 1), 3.0)
            longest = max(len(r.text.split()) for r in rows)
            assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
            assert max(Counter(got).values()) <= 3 and set(got) <= set(rows)
            want = got
        assert sorted(got) == sorted(want) and 0 < len(want)
        docs = out


def test_keepers_of_odd_rows(spark, odd, empty):
    from tallymix.llm import exact_dedup, mixing, ngram_join

    for keep in (exact_dedup.keep, ngram_join.keep, mixing.mixture):
        assert keep(empty).collect() == []
        assert keep(odd).columns == odd.columns
    exact = exact_dedup.keep(odd).collect()
    texts = [ascii_lower(r.text or "") for r in exact]
    assert len(texts) == len(set(texts)) == len({ascii_lower(r.text or "") for r in odd.collect()})
    near = ngram_join.keep(odd).collect()
    assert Counter(r.doc_id for r in near)[7] + Counter(r.doc_id for r in near)[6] >= 1
    wordless = [r for r in odd.collect() if not (r.text or "").split()]
    assert sum(not (r.text or "").split() for r in near) == len(wordless)
