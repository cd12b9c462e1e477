"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A text is cut into pieces by the vocabulary's pattern; each piece is merged by itself. The leaves of a piece's tree stand
for its bytes: leaf i holds the rank of the pair that begins at byte i, together with i, or NONE where no live token
begins there or the pair has no rank. Each inner node holds the least of its two children, so the root names the leftmost pair of
the least rank. A merge writes the leaves of the merged token, of the token swallowed and of the live neighbour before
it, and the nodes above them: O(log n) for a piece of n bytes, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import id_long, id_text
from tallymix.llm.tokens import groups, public_path

RANKS = "byte_bpe_50k.tiktoken"
MEMO_PIECES = 400_000  # distinct pieces kept per worker; the memo starts anew beyond
SHORT = 64  # pieces up to so many bytes are merged side by side, longer ones each by itself
NONE = np.iinfo(np.int64).max


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Ranks by byte string, and the rank of every pair of tokens that joins to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.base = max(self.bytes) + 1
        joined = {self.ranks[t[:i]] * self.base + self.ranks[t[i:]]: rank for t, rank in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[p] for p in self.pairs.tolist()], np.int64)
        self.joined = joined

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NONE where they don't join to one."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_many(pieces: list[bytes], vocab: Vocabulary, leaves: int) -> list[np.ndarray]:
    """Ids of pieces of 1 to ``leaves`` bytes (a power of two): one merge of every unfinished piece per step."""
    n, size = len(pieces), np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
    places = np.arange(leaves)
    ids = np.where(places < size[:, None], vocab.of_byte[raw], -1)
    after = np.broadcast_to(places + 1, (n, leaves)).copy()
    before = np.broadcast_to(places - 1, (n, leaves)).copy()
    tree = np.full((n, 2 * leaves), NONE)
    row, at = np.nonzero(places[None, :-1] < size[:, None] - 1)
    rank = vocab.rank_of(ids[row, at], ids[row, at + 1])
    tree[row, leaves + at] = np.where(rank == NONE, NONE, rank * leaves + at)
    for node in range(leaves - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(rows, leaf, rank):
        node = leaf + leaves
        tree[rows, node] = np.where(rank == NONE, NONE, rank * leaves + leaf)
        while node[0] > 1:  # every path has the same length
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        rank, at = np.divmod(tree[live, 1], leaves)
        gone = after[live, at]
        then = after[live, gone]
        ids[live, at], ids[live, gone], after[live, at] = rank, -1, then
        put(live, gone, np.full(len(live), NONE))
        follows = then < size[live]
        put(live, at, np.where(follows, vocab.rank_of(rank, ids[live, np.where(follows, then, 0)]), NONE))
        before[live[follows], then[follows]] = at[follows]
        back = np.flatnonzero(before[live, at] >= 0)
        if len(back):
            rows, previous = live[back], before[live[back], at[back]]
            put(rows, previous, vocab.rank_of(ids[rows, previous], rank[back]))
        live = live[tree[live, 1] != NONE]
    return [x[x >= 0] for x in ids]


def merge_one(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """Ids of one piece of any length, in flat arrays of about 50 bytes for each of its own."""
    n = len(piece)
    leaves = 1 << max(0, n - 1).bit_length()
    ids = array("q", vocab.of_byte[np.frombuffer(piece, np.uint8)].tolist())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    first = np.full(2 * leaves, NONE)
    raw = np.frombuffer(ids, np.int64)
    rank = vocab.rank_of(raw[:-1], raw[1:])
    first[leaves:leaves + n - 1] = np.where(rank == NONE, NONE, rank * leaves + np.arange(n - 1))
    level = leaves
    while level > 1:
        first[level // 2:level] = np.minimum(first[level:2 * level:2], first[level + 1:2 * level:2])
        level //= 2
    tree, joined, base, none = array("q", first.tobytes()), vocab.joined, vocab.base, int(NONE)
    del raw, rank, first

    def put(leaf: int, rank: int | None) -> None:
        node = leaf + leaves
        tree[node] = none if rank is None else rank * leaves + leaf
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while tree[1] != none:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        then = after[gone]
        ids[at], ids[gone], after[at] = rank, -1, then
        put(gone, None)
        if then < n:
            before[then] = at
            put(at, joined.get(rank * base + ids[then]))
        else:
            put(at, None)
        if (previous := before[at]) >= 0:
            put(previous, joined.get(ids[previous] * base + rank))
    out = np.frombuffer(ids, np.int64)
    return out[out >= 0]


def merge(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each piece. A piece that is a token is that token, as in the library."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (rank := vocab.ranks.get(piece)) is not None:
            out[i] = np.array([rank])
        elif len(piece) <= SHORT:
            classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        else:
            out[i] = merge_one(piece, vocab)
    for leaves, own in classes.items():
        for low in range(0, len(own), 4096):
            part = own[low:low + 4096]
            for i, ids in zip(part, merge_many([pieces[i] for i in part], vocab, leaves)):
                out[i] = ids
    return out


def _library_class(kind: str) -> str:
    """The code points that the library's expressions take as ``kind`` (such as \\p{L}), in order."""
    import tiktoken

    plain = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)},
                              special_tokens={})
    return bytes(plain.encode_ordinary(_every())).decode()


def _every() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=2)
def _patterns(pattern: str):
    """(pattern, the same with the library's own letters and digits, the first code point where they differ): the
    two expression engines know different versions of Unicode."""
    import regex

    exact, first = pattern, 0x110000
    for kind in (r"\p{L}", r"\p{N}"):
        if kind not in pattern:
            continue
        known = _library_class(kind)
        first = min([first, *map(ord, set(regex.findall(kind, _every())).symmetric_difference(known))])
        points = np.array([ord(c) for c in known])
        cuts = np.flatnonzero(np.diff(points) > 1)
        spans = zip(points[np.concatenate([[0], cuts + 1])], points[np.concatenate([cuts, [len(points) - 1]])])
        body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
        exact = exact.replace(kind, "\0" + body + "\1")
    parts, inside, i = [], False, 0
    while i < len(exact):  # a class within brackets goes without brackets of its own
        c = exact[i]
        if c == "\\" and exact[i + 1:i + 2]:
            parts.append(exact[i:i + 2])
            i += 2
            continue
        inside = True if c == "[" else False if c == "]" else inside
        parts.append({"\0": "" if inside else "[", "\1": "" if inside else "]"}.get(c, c))
        i += 1
    return regex.compile(pattern), regex.compile("".join(parts)), first


@lru_cache(maxsize=2)
def _plain(pattern: str):
    import regex

    return regex.compile(pattern)


def pieces_of(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, as the library finds them."""
    if text.isascii():
        return _plain(pattern).findall(text)
    usual, exact, first = _patterns(pattern)
    return (usual if ord(max(text)) < first else exact).findall(text)


@lru_cache(maxsize=2)
def _memo(path: str) -> dict[str, bytes]:
    return {}


def encode(texts, path: str | None = None, pattern: str | None = None, memo_pieces: int = MEMO_PIECES) -> Iterator[bytes]:
    """Yields the ids of each text (null: none) as little-endian unsigned 32-bit bytes."""
    path, pattern = path or public_path(RANKS), pattern or public_pattern()
    vocab, memo = vocabulary(path), _memo(path)
    for part in groups(texts):
        split = [pieces_of(t or "", pattern) for t in part]
        known = [list(map(memo.get, pieces)) for pieces in split]
        gaps = [[i for i, ids in enumerate(found) if ids is None] for found in known]
        if len(memo) > memo_pieces:
            memo.clear()
        new = {pieces[i] for pieces, at in zip(split, gaps) for i in at}
        new = [p for p in new if p not in memo]
        for p, ids in zip(new, merge([p.encode() for p in new], vocab)):
            memo[p] = ids.astype("<u4").tobytes()
        for pieces, found, at in zip(split, known, gaps):
            for i in at:
                found[i] = memo[pieces[i]]
            yield b"".join(found)


def decode(ids: bytes, path: str | None = None) -> bytes:
    """The bytes of ids given as little-endian unsigned 32-bit numbers."""
    token = vocabulary(path or public_path(RANKS)).bytes
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (little-endian unsigned 32-bit bytes), n_tokens, decoded
    (the bytes of the ids, taken from them anew).

    Null and empty texts have no ids. Texts are encoded whole; a long piece takes n log n steps and some 50 bytes a
    byte. Repeated rows are encoded each, an empty table gives an empty result, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                ids = list(encode(part["text"], path, pattern))
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "n_tokens": [len(x) >> 2 for x in ids],
                                    "decoded": [decode(x, path) for x in ids]})

    return id_long(_rows(docs).mapInPandas(run, "doc_id string, ids binary, n_tokens bigint, decoded binary"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with ids and decoded bytes as lowercase hex sha256: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        for batch in batches:
            out = []
            for ids in encode(batch["text"], path, pattern):
                out.append((len(ids) >> 2, hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(decode(ids, path)).hexdigest()))
            found = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            found.insert(0, "doc_id", batch["doc_id"].values)
            yield found

    schema = "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return id_long(_rows(docs).mapInPandas(run, schema))


def _rows(docs: DataFrame) -> DataFrame:
    return id_text(docs.select("doc_id", F.col("text").cast("string").alias("text")))
