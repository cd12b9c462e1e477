"""Token files of fixed-width bit-packed blocks.

A file set has two Parquet folders. ``blocks``: rows (shard, block, start, n_ids, bits, doc_ids, n_tokens, payload);
a payload holds ``n_ids`` ids of ``bits`` bits each, little-endian, of whole documents in ascending order; ``start``
counts the ids of the shard before it, ``n_tokens`` the ids of each document. ``shards``: rows (shard, start, n_ids,
first_doc, last_doc), shards in ascending order of documents, ``start`` counting all ids before. Id i of a block
stands at bit i * bits, so any range is unpacked without what precedes it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymix.llm import tokens
from tallymix.llm.common import id_long, id_text

BLOCK_IDS = 65_536
BLOCKS = ("shard int, block int, start bigint, n_ids bigint, bits int, doc_ids array<bigint>, n_tokens array<bigint>, "
          "payload binary")


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a block, as little-endian 32-bit numbers; only their bytes are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    low, high = first * bits, (first + count) * bits
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[low // 8:(high + 7) // 8], bitorder="little")
    planes = raw[low % 8:low % 8 + count * bits].reshape(count, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``docs`` (doc_id, text; null text is empty) and writes them in ascending doc_id order below ``path``.

    Documents are dealt out by ranges of doc_id, one shard a task, so nothing but a shard's few blocks is ever held.
    A document lies in one block; a block closes when it holds ``block_ids`` ids. Null doc_ids come first, repeated
    ones in order of their texts. Spark's committer writes the files, so a lost task leaves none behind. An empty
    table gives folders without rows. Other columns are ignored.
    """
    tokenizer = tokenizer or tokens.public_path()
    bits = width(max(tokens.vocabulary(tokenizer), end_id + 1))

    def shard(batches):
        number, block, start, total = TaskContext.get().partitionId(), 0, 0, 0
        held, names, sizes = [], [], []

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pd.DataFrame({"shard": [number], "block": [block], "start": [start], "n_ids": [len(ids)],
                                 "bits": [bits], "doc_ids": [names], "n_tokens": [sizes],
                                 "payload": [pack_ids(ids, bits)]})

        for batch in batches:
            named = zip(batch["doc_id"], tokens.encode(batch["text"], tokenizer, end_id))
            for doc, ids in named:
                held.append(ids)
                names.append(None if pd.isna(doc) else int(doc))
                sizes.append(len(ids) // 4)
                total += sizes[-1]
                if total >= block_ids:
                    yield row()
                    block, start, total = block + 1, start + total, 0
                    held, names, sizes = [], [], []
        if held:
            yield row()

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    id_text(ordered).mapInPandas(shard, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(
        F.sum("n_ids").alias("n_ids"), F.min(F.array_min("doc_ids")).alias("first_doc"),
        F.max(F.array_max("doc_ids")).alias("last_doc"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the write
    shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", "first_doc",
                  "last_doc").write.mode("overwrite").parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("base"))
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digests(batches):
        for batch in batches:
            out = []
            for b in batch.itertuples(index=False):
                ids = unpack_ids(b.payload, b.bits, 0, b.n_ids)
                at = 0
                for doc, n in zip(b.doc_ids, b.n_tokens):
                    n = int(n)
                    out.append((doc, b.base + b.start + at, n, zlib.crc32(ids[at:at + n].tobytes())))
                    at += n
            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = _blocks(spark, path).withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    return id_long(rows.mapInPandas(digests, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: (doc_id, ids) of the given documents. Shards and blocks that cannot hold them are not read,
    and of a block only the documents' bytes are unpacked."""
    wanted = sorted({int(d) for d in doc_ids})

    def pick(batches):
        for batch in batches:
            out = []
            for b in batch.itertuples(index=False):
                at = np.concatenate([[0], np.cumsum(np.asarray(b.n_tokens, np.int64))])
                for i, doc in enumerate(b.doc_ids):
                    if doc is not None and doc == doc and int(doc) in chosen:
                        out.append((int(doc), unpack_ids(b.payload, b.bits, int(at[i]), int(at[i + 1] - at[i])).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "ids"])

    chosen = frozenset(wanted)
    shards = spark.read.parquet(f"{path}/shards")
    if wanted:
        near = [r.shard for r in shards.where((F.col("last_doc") >= wanted[0]) & (F.col("first_doc") <= wanted[-1]))
                .select("shard").collect()]
    else:
        near = []
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.col("shard").isin(near))
    blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in wanted])))
    blocks = blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    return blocks.mapInPandas(pick, "doc_id bigint, ids array<bigint>")
