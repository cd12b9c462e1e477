"""Mixture-controlled packing: deficit round-robin over the queues of the sources."""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm import tokens
from tallymix.llm.common import id_long, id_text, KEY_BITS, order_key
from tallymix.workspace import Workspace

PARTS = 1 << 16  # parts of an id in which quanta are counted
TOKENS = "key bigint, doc_id bigint, source string, n bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, source string")


def token_table(docs: DataFrame, ws: Workspace, tokenizer: str, end_id: int,
                memo_words: int = tokens.MEMO_WORDS) -> DataFrame:
    """Every row encoded once and written: a key of its own, doc_id, source, number of ids and the ids in two bytes
    each if the vocabulary allows, else four."""
    wide = "<u2" if max(tokens.vocabulary(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches):
        number, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            encoded = tokens.encode(batch["text"], tokenizer, end_id, memo_words)
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                ids = [np.frombuffer(b, "<u4") for b in islice(encoded, len(part))]
                yield pd.DataFrame({
                    "key": np.arange(row, row + len(part)) + (number << 40), "doc_id": part["doc_id"].values,
                    "source": part["source"].values, "n": [len(x) for x in ids],
                    "ids": [x.astype(wide).tobytes() for x in ids],
                })
                row += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"))
    return ws.put(id_long(id_text(rows).mapInPandas(run, TOKENS.replace("doc_id bigint", "doc_id string"))), "tokens")


def queue_positions(rows: DataFrame, seed: int, targets: Mapping[str, float] | None, bits: int = 12) -> DataFrame:
    """(key, n, queue_start, share): where in its source's queue each document begins, and the share of a round that
    the source is due. Queues are in seeded hash order; without ``targets`` each source is due its share of all
    tokens, so that all queues end together; with them, a source that is not named is due a thousandth of the least target."""
    rows = rows.select("key", "n", F.col("source").isNull().alias("missing"),
                       F.coalesce("source", F.lit("")).alias("name"), order_key(seed, "doc_id").alias("order"))
    rows = rows.withColumn("part", F.shiftright("order", KEY_BITS - bits))
    parts = rows.groupBy("missing", "name", "part").agg(F.sum("n").alias("part_size"))
    sizes = parts.groupBy("missing", "name").agg(F.sum("part_size").alias("size"))
    if targets:
        known = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])
        due = F.coalesce(F.when(~F.col("missing"), known[F.col("name")]), F.lit(min(targets.values()) / 1000))
    else:
        due = F.col("size").cast("double")
    sizes = sizes.withColumn("due", due).withColumn("share", F.col("due") / F.sum("due").over(Window.partitionBy()))
    earlier = Window.partitionBy("missing", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.select("missing", "name", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"))
    plan = plan.join(sizes, ["missing", "name"])
    inside = Window.partitionBy("missing", "name", "part").orderBy("order", "key")
    start = F.col("base") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.join(plan, ["missing", "name", "part"]).select(
        "key", "n", "missing", "name", "share", start.alias("queue_start"))


def turns(queues: DataFrame, length: int, least: int) -> DataFrame:
    """Adds ``quantum`` (what a source earns a round, in parts of an id), ``every`` and ``phase`` (it sends in the rounds r
    with (r + phase) % every = 0): a source that earns fewer than ``least`` ids a round waits until it has as many, and
    such sources take their turns in different rounds."""
    quantum = F.greatest(F.lit(1), F.floor(length * F.col("share") * F.lit(float(PARTS)))).cast("long")
    rows = queues.withColumn("quantum", quantum)
    rows = rows.withColumn("every", F.expr(f"({least * PARTS} + quantum - 1) div quantum"))
    return rows.withColumn("phase", F.expr("pmod(xxhash64(missing, name), every)"))


def schedule(queues: DataFrame, length: int, least: int) -> DataFrame:
    """Pieces (key, start, size, sequence_id, offset) of all queues.

    In each round a source earns ``length * share`` ids; at its turn it sends all whole ids that it has earned and not
    yet sent, cutting documents where they end, and carries the rest on. As every queue holds its
    documents from the start, turn j of a source ends at id floor((j * every - phase) * quantum) of its queue, on
    whatever partition that lies. Packets in order of rounds, end to end, are cut into sequences.
    """
    rows = turns(queues, length, least)
    turn = (f"((({{0}}) * {PARTS} + quantum - 1) div quantum + phase + every - 1) div every")  # the turn that sends an id
    until = f"((turn - {{0}}) * every - phase) * quantum div {PARTS}"
    first, final = turn.format("queue_start + 1"), turn.format("queue_start + n")
    packets = rows.withColumn("turn", F.expr(f"explode(sequence({first}, {final}))"))
    packets = packets.withColumn("at", F.expr(f"greatest(queue_start, {until.format(1)})"))
    packets = packets.withColumn("size", F.expr(f"least(queue_start + n, {until.format(0)}) - at"))
    packets = packets.withColumn("start", F.col("at") - F.col("queue_start"))
    packets = packets.withColumn("round", F.expr("turn * every - phase"))
    packets = packets.withColumn("block", F.floor(F.col("round") / 64))
    # Totals of 64 rounds, then of 4096 such blocks: the last window has one row per 2**18 sequences.
    blocks = packets.groupBy("block").agg(F.sum("size").alias("total")).withColumn("top", F.floor(F.col("block") / 4096))
    tops = blocks.groupBy("top").agg(F.sum("total").alias("total"))
    before = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("top", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("top_base"))
    before = Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inner", F.coalesce(F.sum("total").over(before), F.lit(0)))
    blocks = blocks.join(tops, "top").select("block", (F.col("inner") + F.col("top_base")).alias("base"))
    inside = Window.partitionBy("block").orderBy("round", "missing", "name", "at")
    first = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = packets.join(blocks, "block").withColumn("first", first).withColumn("last", F.col("first") + F.col("size"))
    cut = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("last") - 1) / length))
    placed = placed.withColumn("sequence_id", F.explode(cut))
    low = F.greatest("first", F.col("sequence_id") * length)
    high = F.least("last", (F.col("sequence_id") + 1) * length)
    return placed.select("key", (F.col("start") + low - F.col("first")).alias("start"), (high - low).alias("size"),
                         "sequence_id", (low - F.col("sequence_id") * length).alias("offset"))


def pack(docs: DataFrame, length: int = 2048, least: int = 32, targets: Mapping[str, float] | None = None,
         seed: int = 11, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False,
         memo_words: int = tokens.MEMO_WORDS, ws: Workspace | None = None) -> DataFrame:
    """Packs ``docs`` (doc_id, text, source) into sequences of ``length`` ids, each filled to the sources' shares.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian
    32-bit numbers), doc_tokens, sequence_id, offset, source; with ``with_ids`` also the ids. A text is encoded whole
    (null: empty) and followed by ``end_id``; each id lies in one piece. Only the last sequence is not full.
    A sequence holds what each source is due in it, but that sources due fewer than ``least`` ids come in every so many.

    ``targets``: relative amounts by source, filled while their queues last; None: the sources' own shares. Null and
    '' are sources of their own. Repeated rows are packed each on its own. An empty table gives no pieces. Other
    columns are ignored. The encoded ids are written to the workspace once; ``memo_words`` bounds
    the words that a Python worker remembers.
    """
    tokenizer = tokenizer or tokens.public_path()
    ws = ws or Workspace(docs.sparkSession)
    wide = "<u2" if max(tokens.vocabulary(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    table = token_table(docs, ws, tokenizer, end_id, memo_words)
    queues = ws.put(queue_positions(table, seed, targets), "queues")
    pieces = schedule(queues, length, least)
    by_row = pieces.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "size", "sequence_id", "offset"))).alias("p"))
    joined = table.join(by_row, "key").select(
        "doc_id", "source", "n", "ids", *[F.col(f"p.{c}").alias(c) for c in ("start", "size", "sequence_id", "offset")])
    schema = PIECES + ", ids array<bigint>" * with_ids

    def digests(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at:at + 2000]
                crcs, own = [], []
                for raw, starts, sizes in zip(part["ids"], part["start"], part["size"]):
                    ids = memoryview(np.frombuffer(raw, wide).astype("<u4")).cast("B")
                    for a, n in zip(starts.tolist(), sizes.tolist()):
                        crcs.append(zlib.crc32(ids[4 * a:4 * (a + n)]))
                        if with_ids:
                            own.append(np.frombuffer(ids[4 * a:4 * (a + n)], "<u4"))
                times = part["start"].map(len).to_numpy()
                out = pd.DataFrame({
                    "doc_id": part["doc_id"].repeat(times).array, "start": np.concatenate(part["start"].array),
                    "length": np.concatenate(part["size"].array), "ids_crc32": np.array(crcs, np.int64),
                    "doc_tokens": part["n"].repeat(times).array, "sequence_id": np.concatenate(part["sequence_id"].array),
                    "offset": np.concatenate(part["offset"].array), "source": part["source"].repeat(times).array,
                })
                yield out.assign(ids=own) if with_ids else out

    return id_long(id_text(joined).mapInPandas(digests, schema.replace("doc_id bigint", "doc_id string")))
