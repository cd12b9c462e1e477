"""Token counts of fields or sections: whole texts are encoded once, token spans joined to section spans."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm import tokens
from tallymix.llm.common import id_long, id_text

RULES = ("first", "last", "most")


def shares(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str = "most"):
    """(section or -1, characters inside it) of each token, for disjoint sections [low, high).

    A token [start, end) meets a section if they share a character; both lists ascend, so the tokens that meet a
    section are one range. A token that meets several goes to the first, the last or the one with most of its
    characters (of equals the first); it crosses a boundary if any of it lies outside.
    """
    order = np.argsort(lows, kind="stable")
    owner, best = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    for k in order.tolist():
        if highs[k] <= lows[k]:
            continue
        i, j = np.searchsorted(ends, lows[k], "right"), np.searchsorted(starts, highs[k], "left")
        inside = np.minimum(ends[i:j], highs[k]) - np.maximum(starts[i:j], lows[k])
        takes = inside > (best[i:j] if rule == "most" else 0)
        if rule == "first":
            takes &= owner[i:j] < 0
        owner[i:j][takes], best[i:j][takes] = k, inside[takes]
    return owner, best


def title_lead_body(text: Column) -> Column:
    """Three sections: up to the first sentence sign of the first line, the rest of that line, all other lines."""
    size = F.length(text)
    head = F.length(F.regexp_extract(text, r"^[^.!?\n]*", 0))
    line = F.length(F.regexp_extract(text, r"^[^\n]*", 0))
    title = F.least(head + 1, line)

    def section(name, low, high):
        return F.struct(F.lit(name).alias("name"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    return F.array(section("title", F.lit(0), title), section("lead", title, line), section("body", line, size))


def attribute(docs: DataFrame, sections: Column, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and section: doc_id, section, low, high, n_tokens, n_crossing,
    doc_tokens, rest_tokens.

    ``sections`` is an array of (name, low, high) with disjoint spans [low, high) of code points of ``text`` (null:
    empty). A text is encoded once, as a whole; each token goes to one section by ``rule`` ('first', 'last' or
    'most', see ``shares``), so boundaries never change how a text is encoded, and n_tokens of all sections plus
    rest_tokens (tokens that meet none) give doc_tokens. Empty sections get 0. A row whose sections are null or
    empty gives no rows. Repeated rows give their rows each. Other columns are ignored, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tokenizer = tokenizer or tokens.public_path()

    def run(batches):
        for batch in batches:
            encoded = tokens.encode_spans(batch["text"], tokenizer)
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                out = []
                for doc, names, lows, highs, (ids, starts, ends) in zip(
                        part["doc_id"], part["names"], part["lows"], part["highs"], islice(encoded, len(part))):
                    owner, inside = shares(starts, ends, lows, highs, rule)
                    cross = (owner >= 0) & (inside < ends - starts)
                    own = np.bincount(owner[owner >= 0], minlength=len(lows))
                    over = np.bincount(owner[cross], minlength=len(lows))
                    rest = len(ids) - int(own.sum())
                    out += [(doc, name, low, high, n, c, len(ids), rest)
                            for name, low, high, n, c in zip(names, lows, highs, own, over)]
                yield pd.DataFrame(out, columns=columns)

    columns = ["doc_id", "section", "low", "high", "n_tokens", "n_crossing", "doc_tokens", "rest_tokens"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sections", sections).where(F.size("sections") > 0)
    rows = rows.select("doc_id", "text", F.col("sections.name").alias("names"), F.col("sections.low").alias("lows"),
                       F.col("sections.high").alias("highs"))
    return id_long(id_text(rows).mapInPandas(run, "doc_id string, section string, low bigint, high bigint, n_tokens bigint, "
                                 "n_crossing bigint, doc_tokens bigint, rest_tokens bigint"))
