"""Quality by line sequences: a linear-chain conditional random field marks each line content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import id_long, id_text, gram_hashes, order_key, words

SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SIGNS, _SPACE = b"!\"'()+,-./:;=?@[]_{}~", b" \t\n\x0b\x0c\r"
_BLANK = " \t\n\x0b\x0c\r"
N_FEATURES = 10
TRAIN_DOCS = 2000  # labelled documents per class that a model is fitted on, at most
TRAIN_LINES = 200  # and lines of such a document


def repeated_words(ws: list[str], n: int = 8) -> int:
    """Words that lie in an ``n``-word window found twice or more."""
    if len(ws) <= n:
        return 0
    h = np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)
    g = gram_hashes(h, n)
    order = np.sort(g)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    maybe = np.flatnonzero(np.isin(g, twice))
    places: dict[tuple, list[int]] = {}
    for i in maybe.tolist():
        places.setdefault(tuple(ws[i:i + n]), []).append(i)
    edge = np.zeros(len(ws) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(edge, found, 1)
            np.add.at(edge, np.array(found) + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    ws = words(text)
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return (len(ws), sum(map(len, ws)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ws))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, numbers of words) of the lines that have a word."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        ws = words(line)
        if not ws:
            continue
        raw = line.encode("utf-8", "surrogatepass")
        size, n = len(raw), len(ws)
        chars = size - (len(raw) - len(raw.translate(None, _SPACE))) or 1
        share = [(size - len(raw.translate(None, kind))) / chars for kind in (_UPPER, _DIGITS, SYMBOLS, _SIGNS)]
        again = 1 - len(set(ws)) / n
        rows.append((1.0, *share, again, min(np.log1p(n), 6.0), min(chars / n, 20.0), line in seen, "!!" in line))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


@dataclass
class LineModel:
    """Scores of the two labels, 0 boilerplate and 1 content. Before any fit every line is content."""

    emit: np.ndarray = field(default_factory=lambda: np.vstack([np.zeros(N_FEATURES), np.eye(N_FEATURES)[0]]).T)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.emit

    def labels(self, features: np.ndarray) -> np.ndarray:
        """The most probable sequence of labels (Viterbi); ties go to content."""
        if not len(features):
            return np.empty(0, np.int64)
        scores = self.scores(features).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from0, from1 = (0 if a + s00 > b + s10 else 1), (0 if a + s01 > b + s11 else 1)
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
            back.append((from0, from1))
        out = [0 if a > b else 1]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return np.array(out[::-1])

    def content_share(self, text: str | None) -> float:
        """Share of the words that stand in content lines; 0 without words."""
        features, sizes = line_features(text)
        return float((sizes * self.labels(features)).sum() / sizes.sum()) if len(sizes) else 0.0


def _sequence_sums(scores: np.ndarray, step: np.ndarray, lengths: np.ndarray):
    """Log of the partition sum, marginals and pair marginals of padded sequences (forward and backward sums)."""
    d, t, _ = scores.shape
    on = np.arange(t)[None, :] < lengths[:, None]
    alpha, beta = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    alpha[0] = scores[:, 0]
    for i in range(1, t):
        new = np.logaddexp.reduce(alpha[i - 1][:, :, None] + step[None], axis=1) + scores[:, i]
        alpha[i] = np.where(on[:, i, None], new, alpha[i - 1])
    for i in range(t - 2, -1, -1):
        new = np.logaddexp.reduce(step[None] + (scores[:, i + 1] + beta[i + 1])[:, None, :], axis=2)
        beta[i] = np.where(on[:, i + 1, None], new, 0.0)
    total = np.logaddexp.reduce(alpha[-1], axis=1)
    single = np.exp(alpha + beta - total[None, :, None]) * on.T[:, :, None]
    pairs = np.exp(alpha[:-1, :, :, None] + step[None, None] + (scores.transpose(1, 0, 2)[1:] + beta[1:])[:, :, None, :]
                   - total[None, :, None, None]) * on.T[1:, :, None, None]
    return total, single.transpose(1, 0, 2), pairs.sum(axis=(0, 1))


def fit(features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, penalty: float = 1.0) -> LineModel:
    """Maximum penalised likelihood by gradient steps of Adam's size over all sequences at once."""
    if not features:
        return LineModel()
    flat = np.vstack(features)
    mean, scale = flat.mean(axis=0), flat.std(axis=0)
    mean[0], scale[scale == 0] = 0.0, 1.0
    observed, groups = np.zeros((2, 2)), []
    order = sorted(range(len(features)), key=lambda i: len(features[i]))
    for at in range(0, len(order), 250):  # sequences of like lengths are padded together
        own = order[at:at + 250]
        lengths = np.array([len(features[i]) for i in own])
        x, y = np.zeros((len(own), lengths.max(), N_FEATURES)), np.zeros((len(own), lengths.max(), 2))
        for row, i in enumerate(own):
            x[row, :len(features[i])] = (features[i] - mean) / scale
            y[row, np.arange(len(labels[i])), labels[i]] = 1.0
            np.add.at(observed, (labels[i][:-1], labels[i][1:]), 1.0)
        groups.append((x, y, lengths))
    w = np.zeros(N_FEATURES * 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        emit, step = w[:-4].reshape(N_FEATURES, 2), w[-4:].reshape(2, 2)
        slope = np.concatenate([np.zeros(N_FEATURES * 2), observed.ravel()]) - penalty * w
        for x, y, lengths in groups:
            _, single, pairs = _sequence_sums(x @ emit, step, lengths)
            slope[:-4] += np.einsum("dtf,dtk->fk", x, y - single).ravel()
            slope[-4:] -= pairs.ravel()
        slope /= len(flat)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return LineModel(w[:-4].reshape(N_FEATURES, 2), w[-4:].reshape(2, 2), mean, scale)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES,
          seed: int = 3) -> LineModel:
    """Fits the model on ``docs`` (doc_id, text) whose ``labels`` (doc_id, quality 0 or 1) are known.

    Every line takes the label of its document: boilerplate where quality is 0. The sample is bounded: the first
    ``per_class`` labelled ids of each class in seeded hash order, and of these the documents of at most
    ``max_lines`` lines. Without labelled documents of both classes every line counts as content.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    known = known.withColumn("key", order_key(seed, "doc_id"))
    chosen = known.where("quality = 0").orderBy("key", "doc_id").limit(per_class).union(
        known.where("quality = 1").orderBy("key", "doc_id").limit(per_class)).drop("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows

    def features(batches):
        for batch in batches:
            out = []
            for doc, text, quality in zip(batch["doc_id"], batch["text"], batch["quality"]):
                f, _ = line_features(text)
                if 0 < len(f) <= max_lines:
                    out.append((doc, f.astype("<f8").tobytes(), quality))
            yield pd.DataFrame(out, columns=["doc_id", "f", "quality"])

    found = rows.mapInPandas(features, "doc_id bigint, f binary, quality int").collect()
    found.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.f)))
    if len({r.quality for r in found}) < 2:
        return LineModel()
    x = [np.frombuffer(r.f, "<f8").reshape(-1, N_FEATURES) for r in found]
    return fit(x, [np.full(len(f), r.quality) for f, r in zip(x, found)])


def _verdict(text: str | None, model: LineModel, share: float):
    n, chars, symbols, dups, repeats = measures(text)
    failed = n < 20 or 100 * repeats > 30 * n
    content = 0.0 if failed else model.content_share(text)
    return n, chars, symbols, dups, repeats, failed, not failed and content >= share, content


def judge(docs: DataFrame, model: LineModel, share: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share.

    A text without words (null, empty, blank) fails the base rules. What passes them is kept when at least ``share``
    of its words stand in lines that the model marks content; content_share is 0 where the base rules fail. Repeated
    rows are judged alike; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            out = pd.DataFrame([_verdict(t, model, share) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].values)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return id_long(id_text(rows).mapInPandas(run, "doc_id string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                                 "n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"))


def keep(docs: DataFrame, model: LineModel, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; no row moves."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([_verdict(t, model, share)[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
