"""Merkle manifest of a dataset by time-forward processing, with a proof for every row.

Each row is a leaf. The leaves of one language form a tree, in ascending order of doc_id; the roots of these trees, in
order of language, form the tree above them. In every tree, runs of ``fan`` consecutive nodes become their hash until
one node is left; the last run may be shorter.

Nodes are labelled (level, index). A priority queue ordered by label delivers the digests of children to their parent,
so a node is hashed when all it needs is there. A reversed sweep then delivers to each node what a proof needs above
it. Both run on stretches of at most STRETCH neighbouring nodes, each in one task: the queue inside a stretch is a heap;
between stretches it is a table, sorted by label by the shuffle, whose messages are the nodes of the next epoch. An epoch
climbs as many levels as a stretch is high, so a tree of any size takes a few epochs, and no task or driver ever holds
more than a stretch.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import id_long
from tallymix.workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRETCH = 4096  # nodes that a task holds at once, at most
_NODE = ("tree string, size bigint, pos bigint, digest string, doc_id string, claimed string, path string, "
         "subroot string, root string")


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_digest(fields: Mapping[str, Column]) -> Column:
    """The hash of a row's FIELDS: ``-`` for a null, else the number of its bytes in UTF-8, a colon and the value."""
    def part(name: str) -> Column:
        value = fields[name].cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[part(name) for name in FIELDS]), 256)


def steps_up(size: int, height: int, fan: int) -> int:
    """Levels that a stretch of a tree with ``size`` nodes left climbs: to the root if the tree is one stretch."""
    levels, width = 0, 1
    while width < size and levels < height:
        width, levels = width * fan, levels + 1
    return levels


def time_forward(digests: list[str], fan: int, levels: int) -> list[tuple[int, int, str, list[str]]]:
    """The nodes (level, index, digest, digests of children) above a stretch, in order of their labels."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]  # sorted, so a heap
    nodes = []
    while queue:
        level, index, _, own = heapq.heappop(queue)
        children = []
        if level:
            children.append(own)
            while queue and queue[0][0] == level and queue[0][1] == index:
                children.append(heapq.heappop(queue)[3])
            own = digest("".join(children))
        nodes.append((level, index, own, children))
        if level < levels:
            heapq.heappush(queue, (level + 1, index // fan, index, own))
    return nodes


def sweep_back(nodes: list[tuple[int, int, str, list[str]]], fan: int, above: str) -> list[str]:
    """Of each leaf of a stretch, in order: the steps of its proof, from below; ``above`` are those past the stretch.

    A step is ``left|right;``, the digests of the run's other nodes on either side.
    """
    paths: dict[tuple[int, int], str] = {nodes[-1][:2]: above}
    for level, index, _, children in reversed(nodes):
        if not level:
            break
        path = paths.pop((level, index))
        for i in range(len(children)):
            step = "".join(children[:i]) + "|" + "".join(children[i + 1:]) + ";"
            paths[level - 1, index * fan + i] = step + path
    return [paths[0, i] for i in range(len(paths))]


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and the steps of its proof lead to."""
    for step in path.split(";")[:-1]:
        left, right = step.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def _stretches(batches, width: int):
    """Lists of rows of one (tree, stretch), from rows in that order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if key != (now := (row.tree, row.pos // width if row.path is None else row.pos)):
                if rows:
                    yield rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield rows


class Forest:
    """The trees of ``nodes`` (tree, digest and whatever ``order`` names), climbed epoch by epoch."""

    def __init__(self, nodes: DataFrame, order: list[str], fan: int, ws: Workspace, stretch: int = STRETCH):
        self.fan, self.ws, self.height, self.width = fan, ws, 0, 1
        while self.width * fan <= max(stretch, fan):
            self.width, self.height = self.width * fan, self.height + 1
        self.epochs = [ws.put(self._placed(nodes, order), "leaves")]
        most = self.epochs[0].agg(F.max("size")).first()[0] or 0
        while most > 1 or len(self.epochs) < 2:
            self.epochs.append(ws.put(self._climb(self.epochs[-1]), "nodes"))
            most = -(-most // self.width)

    def _placed(self, nodes: DataFrame, order: list[str]) -> DataFrame:
        """Adds each node's place in its tree and the tree's size. The sort is by ranges of (tree, order), so a large tree is
        spread; places are added up from one row per tree and task."""
        ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        ordered = self.ws.put(ordered.withColumn("seq", F.monotonically_increasing_id()), "sorted")
        ordered = ordered.withColumn("part", F.shiftright("seq", 33))  # the id's upper bits are the task
        parts = ordered.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("tree", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
                             F.sum("n").over(Window.partitionBy("tree")).alias("size"))
        placed = ordered.join(parts, ["tree", "part"]).withColumn("pos", F.col("base") + F.col("seq") - F.col("first"))
        return self._rows(placed)

    def _rows(self, df: DataFrame) -> DataFrame:
        names = [c.split()[0] for c in _NODE.split(", ")]
        kinds = dict(c.split() for c in _NODE.split(", "))
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])

    def _by_stretch(self, rows: DataFrame) -> DataFrame:
        own = F.when(F.col("path").isNull(), F.floor(F.col("pos") / self.width)).otherwise(F.col("pos"))
        rows = rows.withColumn("stretch", own).repartition("tree", "stretch")
        return rows.sortWithinPartitions("tree", "stretch", F.col("path").isNull(), "pos").drop("stretch")

    def _climb(self, nodes: DataFrame) -> DataFrame:
        fan, width, height = self.fan, self.width, self.height

        def run(batches):
            out = []
            for rows in _stretches(batches, width):
                top = time_forward([r.digest for r in rows], fan, steps_up(rows[0].size, height, fan))[-1][2]
                out.append((rows[0].tree, -(-rows[0].size // width), rows[0].pos // width, top))
                if len(out) >= 10_000:
                    yield _frame(out)
                    out = []
            yield _frame(out)

        return self._by_stretch(nodes).mapInPandas(run, _NODE)

    def roots(self) -> DataFrame:
        return self.epochs[-1].select("tree", "digest")

    def proofs(self, above: DataFrame) -> DataFrame:
        """Adds to the leaves the steps of their proofs. ``above`` (tree, path, subroot, root): what follows a tree."""
        fan, width, height = self.fan, self.width, self.height

        def run(batches):
            out = []
            for first, *rows in _stretches(batches, width):  # the message from above, then the nodes
                nodes = time_forward([r.digest for r in rows], fan, steps_up(rows[0].size, height, fan))
                for r, path in zip(rows, sweep_back(nodes, fan, first.path)):
                    out.append((r.tree, r.size, r.pos, r.digest, r.doc_id, r.claimed, path, first.subroot, first.root))
                if len(out) >= 10_000:
                    yield _frame(out)
                    out = []
            yield _frame(out)

        above = self._rows(above.withColumn("pos", F.lit(0)))
        for nodes in reversed(self.epochs[:-1]):
            above = self._by_stretch(nodes.unionByName(above)).mapInPandas(run, _NODE)
            if nodes is not self.epochs[0]:
                above = self.ws.put(above, "paths")
        return above


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _NODE.split(", ")]
    return pd.DataFrame([r + (None,) * (len(names) - len(r)) for r in rows], columns=names, dtype=object)


def manifest(docs: DataFrame, claimed: Mapping[str, Column] | None = None, fan: int = 2,
             ws: Workspace | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, lang, leaf, subroot, root, path (the
    steps of the proof), proof_sha256 (hash of all its digests, left to right) and claimed (the leaf of the row with
    the columns of ``claimed`` in place of its own; without them the same leaf).

    Any field may be null, texts may be empty or of any length (only their digest moves). A null lang has a tree of
    its own, before all others; null doc_ids come first in their tree, repeated ones in order of their leaves. A tree of one
    leaf is that leaf, without steps. An empty table gives an empty result. Other columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession)
    kinds = {"doc_id": "long", "n_chars": "long"}
    fields = {c: F.col(c).cast(kinds.get(c, "string")) for c in FIELDS}
    other = fields | {c: v.cast(kinds.get(c, "string")) for c, v in (claimed or {}).items()}
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    # Written: texts are read once, and the sort by ranges sees the same rows in every attempt.
    leaves = ws.put(docs.select(fields["doc_id"].alias("doc_id"), tree.alias("tree"), leaf_digest(fields).alias("digest"),
                                leaf_digest(other).alias("claimed")), "digests")
    below = Forest(leaves, ["doc_id", "digest"], fan, ws, stretch)
    tops = below.roots().select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), "digest")
    over = Forest(tops, ["doc_id"], fan, ws, stretch)
    whole = over.roots().select("tree", F.lit("").alias("path"), F.col("digest").alias("root"))
    found = over.proofs(whole.withColumn("subroot", F.lit(None).cast("string")))
    above = ws.put(found.select(F.col("doc_id").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    rows = below.proofs(above)
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return id_long(rows).select(
        "doc_id", lang.alias("lang"), F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.sha2(F.translate("path", "|;", ""), 256).alias("proof_sha256"), "claimed")


def verify(rows: DataFrame) -> DataFrame:
    """Adds to rows of ``manifest`` folded_root, the root that the claimed leaf and the proof's steps lead to, and verified,
    whether it is the manifest's."""
    def run(batches):
        for batch in batches:
            batch["folded_root"] = [fold(leaf, path) for leaf, path in zip(batch["claimed"], batch["path"])]
            yield batch

    kinds = ", ".join(f"{c} {'string' if t == 'bigint' else t}" for c, t in rows.dtypes)
    folded = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, kinds + ", folded_root string")
    return id_long(folded).withColumn("verified", F.col("folded_root") == F.col("root"))
