"""Words, stable hashes, order keys and running totals shared by the operators."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# White space to str.split() but not to WORD.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
KEY_BITS = 60
MAP_BITS = 1 << 29  # of the maps that keep rows without a partner out of a shuffle, at most: 64 MB

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    if not text:
        return []
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only


def ascii_lower_column(text: Column) -> Column:
    """A-Z in lower case, all else as it is; one byte per character means ``lower`` sees ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes that agree between processes."""
    if not ws:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(ws, dtype=object), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes, in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return out


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as text, for Python: pandas holds a long column with a null as doubles, which rounds above 2**53."""
    return docs.withColumn("doc_id", F.col("doc_id").cast("string"))


def id_long(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def order_key(seed: int, *cols: str) -> Column:
    """A seeded uniform integer below 2**KEY_BITS from the text of the columns; SQL engines with md5 repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_totals(rows: DataFrame, group: list[str], key: str, ties: list[str], value: str, bits: int = 12) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same group that precede by (key, ties).

    ``key`` is uniform below 2**KEY_BITS. Groups are cut into 2**bits ranges of it, so a group with a third of
    all rows is spread over that many parts; only totals of ranges are summed up per group.
    """
    part = F.shiftright(F.col(key), KEY_BITS - bits)
    rows = rows.withColumn("__part", part)
    totals = rows.groupBy(*group, "__part").agg(F.sum(value).alias("__total"))
    ordered = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "__part", F.coalesce(F.sum("__total").over(ordered), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.join(bases, [*group, "__part"]).withColumn("before", before).drop("__part", "__base")


def summed_arrays(partials: DataFrame, kind: str) -> np.ndarray:
    """Adds up (or joins, for bits) one fixed-size array per task, on the executors first."""

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch["v"]:
                x = np.frombuffer(raw, kind)
                total = x.copy() if total is None else (total | x if kind == "u1" else total + x)
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    found = partials.repartition(16).mapInPandas(add, "v binary").repartition(1).mapInPandas(add, "v binary").collect()
    return np.frombuffer(found[0].v, kind) if found else np.zeros(0, kind)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A map with the bits of all keys (one column of longs or strings) set; unset bits surely have no key.

    It has some 16 to 32 bits a key, MAP_BITS at most; with more keys than that suits, fewer rows are kept out."""
    size = min(MAP_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))

    def mark(batches):
        bits, found = np.zeros(size // 8, np.uint8), False
        for batch in batches:
            k = batch.iloc[:, 0]
            at = _slots(word_hashes(k.tolist()).view(np.int64) if k.dtype == object else k.fillna(0).to_numpy(), size)
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            found |= len(at) > 0
        if found:
            yield pd.DataFrame({"v": [bits.tobytes()]})

    found = summed_arrays(keys.mapInPandas(mark, "v binary"), "u1")
    return found if len(found) else np.zeros(size // 8, np.uint8)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slots(keys, 8 * len(bits))
    return bits[at >> 3] & (128 >> (at & 7)).astype(np.uint8) > 0


def chosen_rows(docs: DataFrame, keys: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs``, with their columns, whose (doc_id, digest) are in ``keys`` (doc_id, digest, every): all of
    them where ``every`` is set, else one of each, the least by a hash of all columns."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), digest.alias("digest"))
    keys = keys.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "digest", "every").distinct()
    inner = inner.join(keys, ["id", "digest"])
    order = Window.partitionBy("id", "digest").orderBy(F.xxhash64("row"))
    inner = inner.withColumn("nth", F.row_number().over(order)).where("every or nth = 1")
    return inner.select("row.*")
