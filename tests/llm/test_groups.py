import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallymix.llm import exact_dedup, mixing
from tallymix.llm.common import ascii_lower, words

def brute_groups(rows):
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[ascii_lower(r.text or "")].append(i)
    out = []
    for text, group in by.items():
        keep = max((rows[i].doc_id for i in group if rows[i].doc_id is not None), default=None)
        stays = next(i for i in group if rows[i].doc_id == keep)
        out += [(rows[i].doc_id, keep, len(group), i == stays, hashlib.sha256(text.encode()).hexdigest()) for i in group]
    return sorted(out, key=repr)


def test_exact_groups(corpus, odd, empty):
    for docs in (corpus, odd, empty):
        got = exact_dedup.exact_groups(docs).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_groups(docs.collect())


def test_clashing_identifiers_are_found_and_replaced(corpus):
    weak = lambda c: F.substring(F.md5(c), 1, 2).cast("binary")
    chunks = corpus.select(F.explode(exact_dedup.chunked(F.col("text"))).alias("chunk"))
    last = exact_dedup.IDENTIFIERS[-1]
    assert exact_dedup.verified_identifier(chunks, (weak, last)) is last
    got = exact_dedup.exact_groups(corpus, (weak, last)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(corpus.collect())


def test_chunks_are_whole_and_meet_again_after_an_edit(spark, corpus):
    text = max((r.text for r in corpus.collect()), key=len)
    rows = spark.createDataFrame([(1, text), (2, "an edit at the start, " + text)], "doc_id int, text string")
    a, b = (r[0] for r in rows.orderBy("doc_id").select(exact_dedup.chunked(F.col("text"))).collect())
    assert "".join(a) == text and all(512 <= len(c) <= 8192 for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3


def brute_targets(sizes, weights, cap):
    """Rounds of proportional shares; what lies above a cap is shared again among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] >= cap * sizes[s]]
        if not above:
            target |= {s: level * w[s] for s in free}
            break
        for s in above:
            target[s] = cap * sizes[s]
        free -= set(above)
    return target


def check_mix(docs, **how):
    rows, got = docs.collect(), mixing.mix(docs, **how).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), **how).collect()))  # reruns agree
    assert sorted((str(r.doc_id), len(words(r.text))) for r in rows) == sorted((str(g.doc_id), g.size) for g in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = brute_targets(sizes, how.get("weights", (5, 2, 1)), how.get("max_epochs", 3.0))
    by_source = {(r.doc_id, len(words(r.text))): r.source for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for g in got:
        s = by_source[g.doc_id, g.size]
        assert g.source_size == sizes[s] and abs(g.target - want[s]) <= 1e-9 * max(1, want[s])
        assert g.taken == g.size * g.copies <= 3 * g.size
        taken[s] += g.taken
        largest[s] = max(largest[s], g.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return got


def test_mix(corpus, odd, empty):
    assert len({g.copies for g in check_mix(corpus)}) > 2
    check_mix(corpus, weights=(100, 1, 1, 1, 1, 1, 1), seed=9)
    check_mix(odd)
    check_mix(odd.where("size(split(text, ' ')) < 3"))
    assert mixing.mix(empty).collect() == []
    row = mixing.mix(odd, carry=True).first()
    assert row["row"].asDict().keys() >= {"doc_id", "text", "target", "row"}
