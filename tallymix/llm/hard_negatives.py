"""Hard negatives by an inverted multi-index whose cells are visited best first until the answer is certain.

Vectors are cut into two halves; a codebook per half is fitted on a bounded sample, and every vector lies in the cell of
its two nearest codewords. For an anchor, the score of any vector in a cell is at most the sum of two half bounds:
its own half times the codeword, plus its length times the codeword's radius (the largest distance of a member). The half
bounds are sorted, and a heap over pairs of places yields the cells in descending order of the sum (multi-sequence
algorithm). Once the next sum is below all that is still sought, the rest of the index cannot change the answer.

The index is dealt into shards of some SHARD_ROWS vectors by a hash of the row, so no label, cell or group of copies is ever in
one place; each shard has its own lists and radii. A task takes a block of anchors through the shards of one lane, one shard
at a time, and carries what it found along, so that later shards are left early. Two sweeps: the positives, then, with
their scores known, the windows of negatives.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import KEY_BITS, order_key
from tallymix.workspace import Workspace

CODEWORDS = 16  # per half, so 256 cells a shard
SHARD_ROWS = 8192
SAMPLE = 1 << 20  # numbers that the codebooks are fitted on, at most: 16,384 vectors of 64
LARGEST = 1 << 25  # components are held within this, so that scores of up to 4,096 components fit 64 bits
NO_ID = np.iinfo(np.int64).max  # stands for a null vec_id, which comes last


def fit_codebook(points: np.ndarray, k: int = CODEWORDS, rounds: int = 8) -> np.ndarray:
    """k-means from the first ``k`` distinct points; fewer points give fewer codewords, none a single zero."""
    words = np.unique(points, axis=0)[:0] if not len(points) else points[np.sort(np.unique(points, axis=0, return_index=True)[1])[:k]]
    if not len(words):
        return np.zeros((1, points.shape[1]))
    for _ in range(rounds):
        own = nearest(points, words)
        total, count = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(total, own, points)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)


class Shard:
    """The inverted lists of some vectors: members in order of cells, the radius and the greatest length by codeword."""

    def __init__(self, vectors: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.books, (k1, k2) = books, (len(books[0]), len(books[1]))
        self.cut = books[0].shape[1]
        order = np.argsort(cells, kind="stable")
        self.order, cells = order, cells[order]
        self.vectors = vectors[order]
        self.start = np.searchsorted(cells, np.arange(k1 * k2 + 1)).tolist()
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.exact = self.vectors.astype(float)  # scores are sums of whole numbers; see ``scores``
        self.sides = []
        for half, book, code in ((self.exact[:, :self.cut], books[0], cells // k2), (self.exact[:, self.cut:], books[1], cells % k2)):
            radius, length, used = np.zeros(len(book)), np.zeros(len(book)), np.unique(code)
            np.maximum.at(radius, code, np.sqrt(((half - book[code])**2).sum(axis=1)))
            np.maximum.at(length, code, np.sqrt((half**2).sum(axis=1)))
            self.sides.append((book[used], radius[used], length[used], used.tolist()))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products; by floating point where that is exact, else by whole numbers."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 1 << 52:
            return (self.exact[at] @ anchor.astype(float)).astype(np.int64)
        return self.vectors[at] @ anchor

    def bounds(self, anchor: np.ndarray):
        """For either half: (upper bounds in descending order, lower bounds, codewords), a little widened for rounding."""
        out = []
        for q, (words, radius, length, used) in zip((anchor[:self.cut], anchor[self.cut:]), self.sides):
            q = q.astype(float)
            size = math.sqrt((q**2).sum())
            mid, spread = words @ q, size * radius
            slack = 1 + 1e-9 * size * length
            high = np.minimum(mid + spread, size * length) + slack
            low = np.maximum(mid - spread, -size * length) - slack
            order = np.argsort(-high, kind="stable")
            out.append((high[order].tolist(), low[order].tolist(), [used[i] for i in order.tolist()]))
        return out

    def visit(self, anchor: np.ndarray, most: float = math.inf) -> Iterator[tuple[np.ndarray, float]]:
        """Yields (places of members, bound of all that is still unvisited) in stretches of cells that double in members.
        Cells surely above ``most`` are passed over."""
        if not len(self.order):
            return
        (high1, low1, used1), (high2, low2, used2) = self.bounds(anchor)
        k2, start = len(self.books[1]), self.start
        heap, found, held, want = [(-high1[0] - high2[0], 0, 0)], [], 0, 64
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(high2):
                heapq.heappush(heap, (-high1[i] - high2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(high1):
                heapq.heappush(heap, (-high1[i + 1] - high2[0], i + 1, 0))
            cell = used1[i] * k2 + used2[j]
            a, b = start[cell], start[cell + 1]
            if b > a and low1[i] + low2[j] <= most:
                found.append(np.arange(a, b))
                held += b - a
            if held >= want or not heap:
                rest = -heap[0][0] if heap else -math.inf
                yield (np.concatenate(found) if found else np.empty(0, np.int64)), rest
                found, held, want = [], 0, 2 * want


def first_of(found: list[np.ndarray], want: int) -> list[np.ndarray]:
    """Of (scores, ids, rows): the first ``want`` by score, greatest first, then id and row."""
    order = np.lexsort((found[2], found[1], -found[0]))[:want]
    return [x[order] for x in found]


class Search:
    """The positives, or the negatives in each positive's window, of one anchor over the shards of a lane."""

    def __init__(self, row: int, label: int, vector: np.ndarray, windows: list[int] | None, want: int, low: int, high: int):
        self.row, self.label, self.vector, self.want, self.low, self.high = row, label, vector, want, low, high
        self.windows = windows  # the scores of the positives; None while they are sought
        self.found = [[np.empty(0, np.int64)] * 3 for _ in (windows if windows is not None else [0])]

    def done(self, rest: float) -> bool:
        """Whether nothing with a score of ``rest`` or less can change what was found."""
        for w, found in enumerate(self.found):
            if self.windows is not None and rest * 100 < self.low * self.windows[w]:
                continue
            if len(found[0]) < self.want or found[0][-1] <= rest:
                return False
        return True

    def take(self, shard: Shard, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        most = math.inf if self.windows is None else max((self.high * p / 100 for p in self.windows), default=-math.inf)
        for at, rest in shard.visit(self.vector, most + 1):
            at_rows = shard.order[at]
            if self.windows is None:
                at = at[(labels[at_rows] == self.label) & (rows[at_rows] != self.row)]
            else:
                at = at[labels[at_rows] != self.label]
            at_rows = shard.order[at]
            scores = shard.scores(at, self.vector)
            for w, found in enumerate(self.found):
                fits = np.ones(len(at), bool) if len(found[0]) < self.want else scores >= found[0][-1]
                if self.windows is not None:
                    p = self.windows[w]
                    fits &= (100 * scores <= self.high * p) & (100 * scores >= self.low * p)
                if fits.any():
                    new = (scores[fits], ids[at_rows[fits]], rows[at_rows[fits]])
                    self.found[w] = first_of([np.concatenate(x) for x in zip(found, new)], self.want)
            if self.done(rest):
                return


def _numbers(vectors, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width).astype(np.int64)


class HardNegatives:
    """The steps of the search over ``rows`` (vec_id, label, vector as an array of numbers)."""

    def __init__(self, rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                 high: int = 100, ws: Workspace | None = None, shard_rows: int = SHARD_ROWS):
        self.spark, self.ws = rows.sparkSession, ws or Workspace(rows.sparkSession)
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high
        rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NO_ID))).alias("vec_id"),
                           F.col("label").cast("long").alias("label"), "vector",
                           F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
        sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
                         F.sum(F.col("is_anchor").cast("int")).alias("anchors")).first()
        self.width = max(0, sizes.width or 0)
        self.shards = max(1, -(-sizes.n // shard_rows))
        self.lanes = math.isqrt(self.shards - 1) + 1  # of about as many shards each
        self.blocks = max(1, min(-(-(sizes.anchors or 0) // 128), max(4, -(-(sizes.anchors or 0) // 32_768))))
        books = self._codebooks(rows)
        self.books = books
        self.index = self.ws.put(self._indexed(rows), "index")

    def _codebooks(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Fitted on the first vectors in seeded hash order of vec_id, SAMPLE numbers at most."""
        width, cut = self.width, self.width // 2
        key = order_key(5, "vec_id")
        some = rows.select("vector", key.alias("key"), "vec_id").orderBy("key", "vec_id").limit(SAMPLE // max(1, width) + 1).collect()
        points = np.zeros((len(some), width))
        for i, r in enumerate(some):
            points[i, :len(r.vector)] = r.vector
        points = np.clip(points, -LARGEST, LARGEST)
        return fit_codebook(points[:, :cut]), fit_codebook(points[:, cut:])

    def _indexed(self, rows: DataFrame) -> DataFrame:
        """Every vector with its shard and cell; components held within LARGEST, short vectors filled up with zeros."""
        width, books = self.width, self.books

        def run(batches):
            for batch in batches:
                z = np.zeros((len(batch), width), np.int64)
                for i, v in enumerate(batch["vector"]):
                    z[i, :len(v)] = np.clip(np.asarray(v, float), -LARGEST, LARGEST)
                cut = len(books[0][0])
                cell = nearest(z[:, :cut].astype(float), books[0]) * len(books[1]) + nearest(z[:, cut:].astype(float), books[1])
                yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "is_anchor": batch["is_anchor"],
                                    "cell": cell, "vector": [x.astype("<i4").tobytes() for x in z]})

        found = rows.mapInPandas(run, "vec_id bigint, label bigint, is_anchor boolean, cell bigint, vector binary")
        found = self.ws.put(found.withColumn("row", F.monotonically_increasing_id()), "rows")
        return found.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(self.shards)).cast("int"))

    def _sweep(self, anchors: DataFrame) -> DataFrame:
        """(row, label, vec_id, vector, windows) -> (anchor_row, window, score, vec_id, found_row), the first of each lane.

        All anchors meet all vectors, in blocks of anchors and lanes of shards: the query set is stated, and what a task
        holds is one block and one shard.
        """
        width, books, low, high = self.width, self.books, self.low, self.high
        seeking = "windows" in anchors.columns
        want = self.negatives if seeking else self.positives
        lane = F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1))).alias("lane")
        block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.blocks)).cast("int")
        windows = F.col("windows") if seeking else F.lit(None).cast("array<bigint>")
        left = anchors.select(block.alias("block"), lane, F.lit(-1).alias("shard"), "row", "label", "vec_id", F.lit(0).cast("long").alias("cell"), "vector", windows.alias("windows"))
        right = self.index.select(F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"),
                                  (F.col("shard") % self.lanes).alias("lane"), "shard", "row", "label", "vec_id", "cell", "vector",
                                  F.lit(None).cast("array<bigint>").alias("windows"))

        def runs(batches):
            """Lists of batches of one (block, lane, shard)."""
            key, parts = None, []
            for batch in batches:
                keys = list(zip(batch["block"], batch["lane"], batch["shard"]))
                at = 0
                while at < len(keys):
                    end = at
                    while end < len(keys) and keys[end] == keys[at]:
                        end += 1
                    if keys[at] != key:
                        if parts:
                            yield key, pd.concat(parts)
                        key, parts = keys[at], []
                    parts.append(batch.iloc[at:end])
                    at = end
            if parts:
                yield key, pd.concat(parts)

        def results(searches):
            out = [(s.row, w, *x) for s in searches for w, found in enumerate(s.found) for x in zip(*(f.tolist() for f in found))]
            return pd.DataFrame(out, columns=["anchor_row", "window", "score", "vec_id", "found_row"])

        def run(batches):
            place, searches = None, []
            for (b, lane_no, shard_no), part in runs(batches):
                if (b, lane_no) != place:
                    yield results(searches)
                    place, searches = (b, lane_no), []
                vectors = _numbers(part["vector"].tolist(), width)
                ids, labels, rows = (part[c].to_numpy(np.int64) for c in ("vec_id", "label", "row"))
                if shard_no < 0:
                    known = part["windows"].tolist() if seeking else [None] * len(part)
                    searches = [Search(int(r), int(k), v, None if w is None else [int(x) for x in w], want, low, high)
                                for r, k, v, w in zip(rows, labels, vectors, known)]
                elif searches:
                    shard = Shard(vectors, part["cell"].to_numpy(np.int64), books)
                    for s in searches:
                        s.take(shard, ids, labels, rows)
            yield results(searches)

        both = left.union(right).repartition("block", "lane").sortWithinPartitions("block", "lane", "shard")
        return both.mapInPandas(run, "anchor_row bigint, window int, score bigint, vec_id bigint, found_row bigint")

    def run(self) -> DataFrame:
        anchors = self.index.where("is_anchor").select("row", "label", "vec_id", "vector")
        order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "found_row")
        found = self._sweep(anchors).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.positives)
        found = self.ws.put(found, "positives")
        windows = found.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("p"))
        windows = windows.select(F.col("anchor_row").alias("row"), F.col("p.score").alias("windows"))
        order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "vec_id", "found_row")
        negatives = self._sweep(anchors.join(windows, "row"))
        negatives = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.negatives)
        named = found.select("anchor_row", (F.col("nth") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
        out = negatives.join(named, ["anchor_row", "window"]).join(
            anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
        shown = {c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c)).alias(c) for c in ("anchor_id", "positive_id")}
        return out.select(shown["anchor_id"], shown["positive_id"], F.col("rank").cast("int").alias("rank"),
                          F.when(F.col("vec_id") != F.lit(int(NO_ID)), F.col("vec_id")).alias("negative_id"),
                          "positive_score", F.col("score").alias("negative_score"))


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, each component x as floor(256 * x), x as a double."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", "label", vector.alias("vector")).where("label is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(sound).withColumn("vector", F.transform("vector", lambda x: F.floor(F.least(F.greatest(
        x, F.lit(-float(LARGEST))), F.lit(float(LARGEST))) * 256)))


def mine(embeddings: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, ws: Workspace | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Hard negatives of every anchor among ``embeddings`` (vec_id, label, embedding).

    One row per find: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner
    products of the components as floor(256 * x). An anchor's positives are the first ``positives`` other rows of its
    label, its negatives for one of them the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` percent of that positive's; greater scores come first, ties by vec_id. The result is exact.

    Rows with a null label, vector or component, or a component that isn't finite, take no part. A null vec_id comes last
    among ties, is an anchor only if ``anchors`` says so, and is shown as null. Repeated rows are rows of their own, a
    repeated anchor has a result for each. Vectors of unlike lengths are compared as if filled up with zeros; scaled
    components are held within 2**25 either way. No anchors, no positives or an empty table give no rows. Other columns
    are ignored.
    """
    rows = valid(embeddings).withColumn("label", label)
    return HardNegatives(rows, anchors, positives, negatives, low, high, ws, shard_rows).run()
