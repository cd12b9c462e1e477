import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymix.llm import byte_bpe as b


@pytest.fixture(scope="module")
def vocab():
    return b.vocabulary(b.public_path(b.RANKS))


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=b.public_pattern(), mergeable_ranks=vocab.ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(next(b.encode([text])), "<u4").tolist()


def loop(piece, vocab):
    """Merges one pair at a time, looking at all of them."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((vocab.ranks.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [vocab.ranks[p] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab e'stll \n\t09."), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_as_the_library(text):
    expected = tiktoken.Encoding("own", pat_str=b.public_pattern(), mergeable_ranks=b.vocabulary(
        b.public_path(b.RANKS)).ranks, special_tokens={}).encode_ordinary(text)
    assert ids_of(text) == expected
    assert b.decode(next(b.encode([text]))) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=64), min_size=1, max_size=8))
def test_both_forms_equal_a_loop(pieces):
    vocab = b.vocabulary(b.public_path(b.RANKS))
    together = b.merge_many(pieces, vocab, 64)
    for piece, ids in zip(pieces, together):
        assert ids.tolist() == b.merge_one(piece, vocab).tolist() == loop(piece, vocab)


def test_letters_that_the_two_expression_engines_know_differently(library):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000))]
    text = "".join(c + "a1 " for c in every)
    assert ids_of(text) == library.encode_ordinary(text)


def test_long_pieces_and_texts(library):
    rng = np.random.default_rng(3)
    one = "".join(map(chr, rng.integers(97, 107, 200_000)))
    for text in (one, "x" * 50_000, " " * 50_000 + "a", "\n" * 9_999, one.replace("a", " ") * 5):
        assert ids_of(text) == library.encode_ordinary(text)


def test_a_small_memo_changes_nothing(corpus, library):
    texts = [r.text for r in corpus.collect()]
    b._memo.cache_clear()
    found = list(b.encode(texts, memo_pieces=10))
    assert found == [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]


def test_odd_rows(odd, empty, library):
    rows = odd.collect()
    expected = sorted(str((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                           hashlib.sha256((r.text or "").encode()).hexdigest()))
                      for r in rows for ids in [library.encode_ordinary(r.text or "")])
    assert sorted(str(tuple(r)) for r in b.digests(odd).collect()) == expected
    for r in b.encoded(odd).collect():
        assert b.decode(bytes(r.ids)) == bytes(r.decoded) and r.n_tokens * 4 == len(r.ids)
    assert b.digests(empty).count() == b.encoded(empty).count() == 0


def test_another_vocabulary(library):
    path = b.public_path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("other", pat_str=b.public_pattern(), mergeable_ranks=b.vocabulary(path).ranks, special_tokens={})
    for text in ("Grüße aus Köln, l'été 2024!", "中文 and русский", ""):
        assert np.frombuffer(next(b.encode([text], path)), "<u4").tolist() == other.encode_ordinary(text)
