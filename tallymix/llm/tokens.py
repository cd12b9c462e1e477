"""Token ids of whole texts by the tokenizers library, with a memo of blank-separated words.

For a tokenizer that drops white space and never joins characters across it, the ids of a text are the ids of its
blank-separated words in order. So each distinct word is encoded once per worker and memo, not once per place.
"""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallymix.llm.common import LOWER

TOKENIZER = "word_bpe_49k.json"
MEMO_WORDS = 1_000_000  # words kept per worker; the memo starts anew beyond
SPAN_WORDS = 700_000  # the same where spans are kept too


def public_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> int:
    """Ids lie below this number. Read from the file: the driver needs no tokenizer in memory."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    known = held["model"]["vocab"]
    last = max(known.values(), default=-1) if isinstance(known, dict) else len(known) - 1
    return max([last, *(t["id"] for t in held.get("added_tokens") or [])]) + 1


@lru_cache(maxsize=4)
def _drops_blanks(path: str) -> bool:
    tok = _tokenizer(path)
    probe = ["a b", " a", "b ", "a\nb", "  ", ".", ". ,", "x1 2"]
    return all(
        tok.encode(p, add_special_tokens=False).ids
        == [i for w in p.split() for i in tok.encode(w, add_special_tokens=False).ids] for p in probe
    )


@lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray | None:
    """Whether each id ends a run of letters or of signs, where the vocabulary marks that."""
    tok = _tokenizer(path)
    suffix = getattr(tok.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(vocabulary(path), bool)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith(suffix)
    return ends


@lru_cache(maxsize=4)
def _letters_reach_model(path: str) -> bool:
    """Whether words of a-z come to the tokenizer's model whole and unchanged; probed with all pairs of letters."""
    tok = _tokenizer(path)
    pairs = "".join(a + b for a in LOWER for b in LOWER)
    same = tok.normalizer is None or tok.normalizer.normalize_str(pairs) == pairs
    parts = tok.pre_tokenizer.pre_tokenize_str(pairs) if tok.pre_tokenizer else [(pairs, (0, len(pairs)))]
    added = any(t.content.isalpha() for t in tok.get_added_tokens_decoder().values())
    ids = [t.id for t in tok.model.tokenize(pairs)]
    return same and [w for w, _ in parts] == [pairs] and not added and (
        ids == tok.encode(pairs, add_special_tokens=False).ids)


_SIGNS = ".,;:!?%$&*#|"


class WordMemo(dict):
    """word -> ids as little-endian 32-bit bytes; with spans, (id, start, end) of each token in that form."""

    def __init__(self, path: str, spans: bool = False):
        self.path, self.spans = path, spans
        self.limit = SPAN_WORDS if spans else MEMO_WORDS
        self.width = 12 if spans else 4  # bytes a token

    def learn(self, words: set[str]) -> None:
        """Letters and the signs after them are tokenized apart and letters in lower case, so words that differ only
        in these are put together from the same parts."""
        if len(self) > self.limit:
            self.clear()
        joined, plain, single = [], set(), set()
        marked = _word_ends(self.path) is not None
        for w in words:
            core = w.rstrip(_SIGNS)
            if not (marked and core.isalpha()):
                single.add(w)
                continue
            low = core.lower() if w.isascii() else core
            if low != w:
                joined.append((w, low, w[len(core):]))
                if low in self:
                    continue
            plain.add(low)
        single.update({tail for _, _, tail in joined if tail})
        letters = _letters_reach_model(self.path)
        if letters:
            self._learn_ascii([w for w in plain if w.isascii()])
        plain = [w for w in plain if not (letters and w.isascii())]
        for i in range(0, len(plain), 500):
            self._learn_letters(plain[i:i + 500])
        single = [w for w in single if w not in self]
        tok = _tokenizer(self.path)
        for i in range(0, len(single), 20_000):
            part = single[i:i + 20_000]
            for w, e in zip(part, (tok.encode_batch if self.spans else tok.encode_batch_fast)(part, add_special_tokens=False)):
                self[w] = self._rows(e.ids, e.offsets if self.spans else None)
        self._join(joined)

    def _rows(self, ids, offsets, base: int = 0) -> bytes:
        if not self.spans:
            return np.array(ids, "<u4").tobytes()
        rows = np.empty((len(ids), 3), "<i4")
        rows[:, 0] = ids
        rows[:, 1:] = np.array(offsets, "<i4").reshape(-1, 2) - base
        return rows.tobytes()

    def _join(self, joined: list[tuple[str, str, str]]) -> None:
        """Words from their letters in lower case and the signs after them, whose spans begin where the letters end."""
        if not self.spans:
            for w, low, tail in joined:
                self[w] = self[low] + self[tail] if tail else self[low]
            return
        tails = [self[tail] if tail else b"" for _, _, tail in joined]
        sizes = np.fromiter(map(len, tails), np.int64, len(tails))
        rows = np.frombuffer(b"".join(tails), "<i4").reshape(-1, 3).copy()
        rows[:, 1:] += np.repeat([len(low) for _, low, _ in joined], sizes // 12).astype("<i4")[:, None]
        raw, at = rows.tobytes(), 0
        for (w, low, _), size in zip(joined, sizes.tolist()):
            self[w] = self[low] + raw[at:at + size]
            at += size

    def _learn_ascii(self, part: list[str]) -> None:
        tokenize = _tokenizer(self.path).model.tokenize
        if self.spans:
            for w in part:
                found = [x for t in tokenize(w) for x in (t.id, *t.offsets)]
                self[w] = struct.pack(f"<{len(found)}i", *found)
        else:
            for w in part:
                found = [t.id for t in tokenize(w)]
                self[w] = struct.pack(f"<{len(found)}I", *found)

    def _learn_letters(self, part: list[str]) -> None:
        """Words of letters only are one unit each: encoded in one go, parted after each token that ends a unit."""
        tok, text = _tokenizer(self.path), " ".join(part)
        e = (tok.encode_batch if self.spans else tok.encode_batch_fast)([text], add_special_tokens=False)[0]
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(_word_ends(self.path)[ids]) + 1
        if len(ends) != len(part):
            for w in part:
                one = tok.encode(w, add_special_tokens=False)
                self[w] = self._rows(one.ids, one.offsets)
            return
        base = 0
        if self.spans:
            starts = np.zeros(len(part), np.int64)
            np.cumsum([len(w) + 1 for w in part[:-1]], out=starts[1:])
            base = np.repeat(starts, np.diff(ends, prepend=0))[:, None]
        raw, low = self._rows(ids, e.offsets if self.spans else None, base), 0
        for w, high in zip(part, (ends * self.width).tolist()):
            self[w] = raw[low:high]
            low = high


@lru_cache(maxsize=4)
def _memo(path: str, spans: bool) -> WordMemo:
    return WordMemo(path, spans)


def _words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct blank-separated words of the texts and their lengths, the number of each text's words in that list,
    and where in these numbers each text begins. Columns are split and numbered, so a distinct word is one Python object."""
    column = pc.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), "\n", " ")
    split = pc.split_pattern(column, " ")
    coded = split.values.dictionary_encode()
    own = coded.dictionary
    sizes = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), pa.scalar(" ", own.type))[0].as_py()
    return joined.split(" "), sizes, coded.indices.to_numpy(), split.offsets.to_numpy()


def _look_up(memo: WordMemo, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all tokens of the words, end to end, and the number of tokens of each; unknown words are learnt together."""
    values = list(map(memo.get, ws))
    gaps = list(compress(range(len(ws)), map(is_, values, repeat(None))))
    memo.learn({ws[i] for i in gaps})
    for i in gaps:
        values[i] = memo[ws[i]]
    rows = np.frombuffer(b"".join(values), "<i4").reshape(-1, memo.width // 4)
    return rows, np.fromiter(map(len, values), np.int64, len(values)) // memo.width


def _in_place(codes: np.ndarray, rows: np.ndarray, counts: np.ndarray, step: int = 1 << 18):
    """The rows of the words numbered ``codes``, in order, and where those of each word begin."""
    firsts = np.cumsum(counts) - counts
    begins = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(counts[codes], out=begins[1:])
    out = np.empty((begins[-1], rows.shape[1]), rows.dtype)
    for at in range(0, len(codes), step):
        own, to = codes[at:at + step], begins[at:at + step + 1]
        places = np.repeat(firsts[own] - to[:-1], np.diff(to)) + np.arange(to[0], to[-1])
        np.take(rows, places, axis=0, out=out[to[0]:to[-1]])
    return out, begins


def groups(texts, chars: int = 1_000_000):
    """Lists of texts of about that many characters, so that the words of one list fit in memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(texts, path: str, end_id: int | None = None, memo_words: int = MEMO_WORDS):
    """Yields the ids of each text (null: empty) as little-endian unsigned 32-bit bytes, ``end_id`` after them."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    if not _drops_blanks(path):
        tok = _tokenizer(path)
        for part in groups(texts):
            for e in tok.encode_batch_fast([t or "" for t in part], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes() + end
        return
    memo = _memo(path, False)
    memo.limit = memo_words
    for part in groups(texts):
        ws, _, codes, begins = _words(part)
        rows, at = _in_place(codes, *_look_up(memo, ws))
        raw, at = rows.reshape(-1).view(np.uint8), (at[begins] * memo.width).tolist()
        for low, high in zip(at, at[1:]):
            yield raw[low:high].tobytes() + end


def encode_spans(texts, path: str):
    """Yields (ids, starts, ends) of each text: character spans [start, end) of the tokens in the text as given."""
    if not _drops_blanks(path):
        tok = _tokenizer(path)
        for part in groups(texts):
            for e in tok.encode_batch([t or "" for t in part], add_special_tokens=False):
                at = np.array(e.offsets, np.int64).reshape(-1, 2)
                yield np.array(e.ids, np.uint32), at[:, 0], at[:, 1]
        return
    memo = _memo(path, True)
    for part in groups(texts):
        ws, sizes, codes, begins = _words(part)
        rows, at = _in_place(codes, *_look_up(memo, ws))
        for low, high in zip(begins.tolist(), begins[1:].tolist()):
            own, to = sizes[codes[low:high]] + 1, at[low:high + 1]
            base, found = np.repeat(np.cumsum(own) - own, np.diff(to)), rows[to[0]:to[-1]]
            yield found[:, 0].astype(np.uint32), found[:, 1] + base, found[:, 2] + base
