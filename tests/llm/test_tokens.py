import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymix.llm import bitpack, packing, tokens
from tallymix.workspace import Workspace

PATH = tokens.public_path()


def plain_ids(text, end=1):
    return tokens._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = ["", None, "It's the  THAT's,!! x12 été ÀB́c\n\n á b\x1cc 힣 日本語 <|endoftext|>z", " lead trail ",
         "e ́x  İstanbul ΟΔΟΣ"]


def test_memo_gives_the_ids_and_spans_of_whole_texts(corpus):
    texts = TEXTS + [r.text for r in corpus.select("text").collect()]
    assert tokens._drops_blanks(PATH)
    got = list(tokens.encode(texts, PATH, 1))
    spans = list(tokens.encode_spans(texts, PATH))
    for t, raw, (ids, starts, ends) in zip(texts, got, spans):
        e = tokens._tokenizer(PATH).encode(t or "", add_special_tokens=False)
        assert np.frombuffer(raw, "<u4").tolist() == e.ids + [1]
        assert ids.tolist() == e.ids
        assert list(zip(starts.tolist(), ends.tolist())) == e.offsets


class CountedMemo(tokens.WordMemo):
    def __init__(self, *args):
        super().__init__(*args)
        self.asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


@pytest.mark.parametrize("spans", [False, True])
def test_a_word_is_looked_up_once_however_often_it_stands_in_the_texts(monkeypatch, spans):
    memo = CountedMemo(PATH, spans)
    monkeypatch.setattr(tokens, "_memo", lambda path, spans: memo)
    texts = ["one two,\nONE  Two, été", None, "", "two, one"] * 200
    got = list((tokens.encode_spans if spans else tokens.encode)(texts, PATH))
    assert memo.asked <= len({w for t in texts if t for w in t.replace("\n", " ").split(" ")})
    for t, found in zip(texts, got, strict=True):
        e = tokens._tokenizer(PATH).encode(t or "", add_special_tokens=False)
        if spans:
            assert (found[0].tolist(), list(zip(found[1].tolist(), found[2].tolist()))) == (e.ids, e.offsets)
        else:
            assert np.frombuffer(found, "<u4").tolist() == e.ids


def test_texts_without_any_token():
    assert list(tokens.encode(["", None, " \n"], PATH)) == [b""] * 3
    assert [[len(x) for x in found] for found in tokens.encode_spans(["", None, " \n"], PATH)] == [[0] * 3] * 3


def test_stretches_of_words_in_place():
    rows, counts = np.arange(12, dtype="<i4").reshape(6, 2), np.array([2, 0, 1, 3])
    codes = np.array([3, 1, 0, 0, 2, 3, 1])
    want, ends = [[6, 7], [8, 9], [10, 11], *[[0, 1], [2, 3]] * 2, [4, 5], [6, 7], [8, 9], [10, 11]], [0, 3, 3, 5, 7, 8, 11, 11]
    for step in (1, 2, 5, 100):
        got, begins = tokens._in_place(codes, rows, counts, step)
        assert (got.tolist(), begins.tolist()) == (want, ends)


def test_a_tokenizer_that_keeps_blanks_gets_whole_texts():
    path = tokens.public_path("byte_bpe_50k.json")
    assert not tokens._drops_blanks(path)
    want = tokens._tokenizer(path).encode("to be or not", add_special_tokens=False)
    assert np.frombuffer(next(tokens.encode(["to be or not"], path)), "<u4").tolist() == want.ids
    assert next(tokens.encode_spans(["to be or not"], path))[1].tolist() == [a for a, _ in want.offsets]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_bits_round_trip(bits, values, data):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    packed = bitpack.pack_ids(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert bitpack.unpack_ids(packed, bits, a, b - a).tolist() == ids[a:b].tolist()


def test_width():
    assert [bitpack.width(v) for v in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("block_ids", [1, 500, 1 << 20])
def test_token_files_of_the_corpus(spark, corpus, block_ids):
    path = Workspace(spark).path("files")
    bitpack.write_tokens(corpus, path, PATH, block_ids=block_ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.read_digests(spark, path).collect()}
    want, at = {}, 0
    for r in corpus.select("doc_id", "text").orderBy("doc_id").collect():
        ids = plain_ids(r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want
    some = sorted(want)[3::50]
    texts = {r.doc_id: r.text for r in corpus.collect()}
    read = {r.doc_id: r.ids for r in bitpack.read_documents(spark, path, some).collect()}
    assert read == {d: plain_ids(texts[d]) for d in some}


def test_token_files_of_odd_rows(spark, odd, empty):
    path = Workspace(spark).path("files")
    bitpack.write_tokens(odd, path, PATH)
    rows = bitpack.read_digests(spark, path).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, crc(plain_ids(r.text))) for r in odd.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == want
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    path = Workspace(spark).path("files")
    bitpack.write_tokens(empty, path, PATH)
    assert bitpack.read_digests(spark, path).collect() == []
    assert bitpack.read_documents(spark, path, []).collect() == []


def packed_right(rows, pieces, length):
    """Every id of every row lies in one piece, with right digests; sequences have no gaps and all but one are full."""
    todo, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        todo[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert set(texts) == set(todo)
    for doc, ts in texts.items():
        want = sorted(i for t in ts for i in range(len(plain_ids(t))))
        assert sorted(i for a, n, _, _ in todo[doc] for i in range(a, a + n)) == want
        all_ids = [plain_ids(t) for t in ts]
        for a, n, c, total in todo[doc]:
            assert any(crc(ids[a:a + n]) == c and total == len(ids) for ids in all_ids)
    sizes = []
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        sizes.append(sum(n for _, n in parts))
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(s != length for s in sizes) <= 1 and max(sizes) <= length


def test_packing_is_whole_and_every_window_follows_the_shares(corpus):
    pieces = packing.pack(corpus, 2048, 32).collect()
    packed_right(corpus.collect(), pieces, 2048)
    total, amounts = 0, defaultdict(int)
    window = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total += p.length
        amounts[p.source] += p.length
        window[p.sequence_id][p.source] += p.length
    done = defaultdict(int)
    for i in range(len(window)):
        for s in amounts:
            due = 2048 * amounts[s] / total
            done[s] += window[i][s]
            # a window's cut splits one turn of a source; sources may hold back up to 32 ids each
            assert abs(done[s] - amounts[s] / total * min(total, (i + 1) * 2048)) <= due + 32 + len(amounts)
            if due >= 128 and i < len(window) - 2:
                assert window[i][s] >= due / 2


def test_packing_by_targets_against_a_round_robin_loop(spark, corpus):
    """The closed form of the rounds equals queues served one after the other with carried deficits."""
    targets = {f"src{i}": float(1 + 40 * (i % 3)) for i in range(20)}
    table = packing.token_table(corpus, Workspace(spark), PATH, 1)
    queues = packing.queue_positions(table, 3, targets)
    rows = packing.turns(queues, 256, 8).collect()
    got = packing.schedule(spark.createDataFrame(queues.collect(), queues.schema), 256, 8).collect()
    line = {(g.key, i): g.sequence_id * 256 + g.offset + i - g.start for g in got for i in range(g.start, g.start + g.size)}
    assert len(line) == sum(g.size for g in got) == sum(r.n for r in rows)
    by, source = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r.queue_start):
        by[r.missing, r.name] += [(r.key, i) for i in range(r.n)]
        source[r.missing, r.name] = r
    assert min(r.every for r in rows) == 1 < max(r.every for r in rows)
    at, number, deficit, sent = 0, 0, defaultdict(int), defaultdict(int)
    place = {}
    while len(place) < len(line):
        number += 1
        for name in sorted(by):
            deficit[name] += source[name].quantum
            if (number + source[name].phase) % source[name].every:
                continue
            whole = deficit[name] // packing.PARTS
            deficit[name] -= whole * packing.PARTS
            for key in by[name][sent[name]:sent[name] + whole]:
                place[key] = at
                at += 1
            sent[name] += whole
    assert place == line


def test_packing_of_odd_rows(odd, empty):
    pieces = packing.pack(odd, 128, 32, with_ids=True).collect()
    packed_right(odd.collect(), pieces, 128)
    assert all(crc(p.ids) == p.ids_crc32 for p in pieces)
    packed_right(odd.collect(), packing.pack(odd, 128, 32, targets={"a": 1.0, "b": 2.0}).collect(), 128)
    assert packing.pack(empty).collect() == []
