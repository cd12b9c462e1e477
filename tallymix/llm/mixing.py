"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymix.llm.common import KEY_BITS, WORD, order_key


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Targets of sources: (missing, name, source_size) -> the same with ``target``.

    Sources in order of code points, null last, take the weights in turn. The water level is found in closed form:
    by rising cap per weight, a source is clamped while the level that all later ones would share lies at its cap
    or above. The rows are one per source.
    """
    by_name = Window.orderBy("missing", "name")
    array = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(array, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "name")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(rest))
    s = s.withColumn("clamped", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "missing", "name", "level")))
    level = open_level.over(Window.partitionBy())
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(level.getField("level") * F.col("weight"))
    return s.select("missing", "name", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7, bits: int = 12,
        carry: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0). A source's repetitions target / source_size are split into a
    whole part, given to every document, and a fraction: of the source's documents in seeded hash order, those
    whose middle lies before that fraction of the source's words get one more. So what is taken differs from the
    target by at most half a document per source, and reruns agree.

    Sources null and '' are different. Repeated rows count and are taken each on its own. A source without words
    has target 0 and no copies; an empty table gives an empty result. Other columns are ignored, whatever their
    names; with ``carry`` the input row comes along as struct ``row``.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"), *kept,
    ).withColumn("key", order_key(seed, "doc_id"))
    rows = rows.withColumn("part", F.shiftright("key", KEY_BITS - bits))
    # Totals of (source, range of keys) hold all that a document has to know of the others before it.
    parts = rows.groupBy("missing", "name", "part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("missing", "name").agg(F.sum("part_size").alias("source_size"))
    earlier = Window.partitionBy("missing", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.select("missing", "name", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"))
    plan = plan.join(source_targets(sizes, weights, max_epochs), ["missing", "name"])
    inside = Window.partitionBy("missing", "name", "part").orderBy("key", "doc_id", "size")
    before = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    repeats = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(plan, ["missing", "name", "part"]).withColumn("before", before).withColumn("repeats", repeats)
    whole = F.floor("repeats")
    extra = (F.col("before") + F.col("size") / 2 < (F.col("repeats") - whole) * F.col("source_size")).cast("long")
    return rows.withColumn("copies", whole + extra).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        *(["row"] if carry else []),
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it."""
    taken = mix(docs, carry=True, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
