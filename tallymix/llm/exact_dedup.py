"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import ascii_lower_column, chosen_rows
from tallymix.workspace import Workspace

# At least 512 characters, then up to a vowel, a blank and a letter from f to k; 8192 at most.
CHUNK = r"(?s).{512,8189}?(?:[aeiou][\x20\n][f-k]|\z)|.{1,8192}"
# From short to long; the last is the chunk itself and cannot fail.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 256)), lambda c: c.cast("binary"),
)


def verified_identifier(chunks: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
                        ws: Workspace | None = None) -> Callable[[Column], Column]:
    """The first identifier under which no two different chunks of ``chunks`` (column ``chunk``) fall together.

    Every distinct chunk moves once to be compared byte for byte with those of the same identifier.
    """
    ws = ws or Workspace(chunks.sparkSession)
    for identifier in identifiers[:-1]:
        store = chunks.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
        clashes = ws.put(store.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("n"), "clashes")
        clean = clashes.isEmpty()
        ws.release(clashes)
        if clean:
            return identifier
    return identifiers[-1]


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(docs: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty texts are equal. The
    row with the largest doc_id stays (null is below every number); of repeated rows with that doc_id one stays.
    Only chunk identifiers, not texts, are grouped and joined. Other columns are ignored, whatever their names.
    """
    text = ascii_lower_column(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", text.alias("text"))
    identifier = verified_identifier(base.select(F.explode(chunked(F.col("text"))).alias("chunk")), identifiers)
    recipes = base.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunked(F.col("text")), identifier).alias("recipe"),
    ).withColumn("hash", F.xxhash64("recipe"))
    rows = recipes.groupBy("hash", "recipe", "doc_id", "text_sha256").agg(F.count("*").alias("n"))
    groups = rows.groupBy("hash", "recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    joined = rows.join(groups, ["hash", "recipe"])
    return joined.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``exact_groups``, with all their columns."""
    stays = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"), F.lit(False).alias("every"))
    return chosen_rows(docs, stays, F.sha2(ascii_lower_column(F.coalesce("text", F.lit(""))), 256))
