"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that reveal them."""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm.common import id_long, id_text, bitmap, marked, word_hashes
from tallymix.workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def _emails(text: str):
    free = 0  # what an earlier match has not taken
    at = text.find("@")
    while at >= 0:
        low = at
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            yield low, found.end()
            free = found.end()
        else:
            free = at + 1  # no later match can begin before this sign and pass it
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost non-overlapping per kind, in order."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, kind: int, start: int, end: int) -> str:
    """The protected value in one spelling: kind and lower-case address or digits."""
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}"


def spelled(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words of letters and digits, in lower case, that lie in no protected span."""
    lows, highs = sorted(a for a, _, _ in spans), sorted(b for _, _, b in spans)
    return [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)
            if bisect_left(lows, m.end()) == bisect_right(highs, m.start())]  # no span begins before and ends after


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, str, int]]:
    """(entity, term, hash of the context) for the terms within ``window`` terms of an entity on either side; linear in
    the text and its entities."""
    terms = _terms(text, spans)
    starts = [a for a, _, _ in terms]
    out = []
    for a, kind, b in spans:
        i = bisect_left(starts, a)
        near = [t for _, _, t in terms[max(0, i - window):i + window]]
        mark = int.from_bytes(hashlib.blake2b(" ".join(near).encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1
        name = entity(text, kind, a, b)
        out.append((name, "", mark))  # counts the entity, also where it stands alone
        out += [(name, t, mark) for t in sorted(set(near))]
    return out


_SCAN = ("doc_id string, row bigint, digest bigint, spans array<struct<a:bigint,kind:int,b:bigint>>, entity string, "
         "term string, mark bigint")
_ROWS = 50_000  # of a batch that goes back to Spark, and one document's more


def scan(docs: DataFrame, window: int, ws: Workspace) -> DataFrame:
    """One pass over the texts, written: one row per row of ``docs`` with its base spans, and one, with null spans,
    per entity of a document and term near it."""

    def run(batches):
        number, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out = []
            for doc, text, digest in zip(batch["doc_id"].tolist(), batch["text"], batch["digest"]):
                spans = base_spans(text)
                key = number + row
                row += 1
                listed = [{"a": a, "kind": k, "b": b} for a, k, b in spans]
                out.append((doc, key, digest, listed, None, None, None))
                if spans:
                    out += [(doc, key, digest, None, e, t, m) for e, t, m in contexts(text, spans, window)]
                if len(out) >= _ROWS:
                    yield pd.DataFrame(out, columns=columns).astype({"mark": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"mark": "Int64"})

    columns = ["doc_id", "row", "digest", "spans", "entity", "term", "mark"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ws.put(id_long(id_text(rows.withColumn("digest", F.xxhash64("text"))).mapInPandas(run, _SCAN)), "scan")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): numbers of documents with each of ``terms`` (term). A fixed-size map keeps other terms out."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(terms.select("term")))

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"]:
                if text:
                    own = list(set(_TERM.findall(text.lower())))
                    counts.update(itertools.compress(own, marked(wanted.value, word_hashes(own).view(np.int64))))
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing(docs: DataFrame, scanned: DataFrame, threshold: float, contexts_needed: int, ws: Workspace) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity.

    With probabilities over documents, disclosure is the pointwise mutual information of term and entity divided by
    the entity's information content: log(N * n(term near entity) / (n(term) n(entity))) / log(N / n(entity)). It is
    1 when the term stands nowhere but near the entity and 0 when the two are independent. At least
    ``contexts_needed`` different contexts must show them together, so that copies of one text prove nothing.
    """
    near = scanned.where("spans is null")
    total = scanned.where("spans is not null").count()
    # Rows of (entity, term, mark) first, so that a context copied into many documents is one row per task.
    entities = near.where("term = ''").groupBy("entity").agg(F.countDistinct("row").alias("n_entity"))
    near = near.where("term <> ''")
    seen = near.groupBy("entity", "term", "mark").agg(F.count("*").alias("c"))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= contexts_needed)
    both = near.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = ws.put(pairs.join(both, ["entity", "term"]).join(entities, "entity"), "pairs")
    pairs = pairs.join(term_counts(docs, pairs.select("term").distinct()), "term").where(F.col("n_entity") < total)
    pmi = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    pairs = pairs.withColumn("disclosure", pmi / F.log(total / F.col("n_entity")))
    return ws.put(pairs.where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure"), "revealing")


_PLACES = "id string, digest bigint, term string, places array<struct<a:bigint,b:bigint>>"


def held(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, digest, term, places): the places of the terms of ``shown`` in the whole text of every document with an
    entity, one row per term, however many entities it has. A map sized by its terms keeps most others out."""
    terms = docs.sparkSession.sparkContext.broadcast(bitmap(shown.select("term").distinct()))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, digest in zip(batch["id"], batch["text"], batch["digest"]):
                spans = base_spans(text)
                places: dict[str, list[dict[str, int]]] = {}
                for a, b, t in _terms(text, spans) if spans else ():
                    places.setdefault(t, []).append({"a": a, "b": b})
                own = list(places)
                out += [(doc, digest, t, places[t]) for t in itertools.compress(
                    own, marked(terms.value, word_hashes(own).view(np.int64)))]
                if len(out) >= _ROWS:
                    yield pd.DataFrame(out, columns=columns).astype({"digest": "int64"})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"digest": "int64"})

    columns = ["id", "digest", "term", "places"]
    rows = docs.select(_key("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("digest", F.xxhash64("text")).mapInPandas(run, _PLACES)


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("id")


def _number(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, window: int = 5, threshold: float = 0.8, contexts_needed: int = 2, removal: float = 0.95,
         ws: Workspace | None = None, everywhere: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found, digest
    (xxhash64 of the text).

    ``found`` lists (start, kind, end) of the base patterns and of the revealing terms, in code points. A term near a
    protected entity of a document is marked wherever it stands in that document: as 'term' (to be generalised) from
    ``threshold`` of disclosure on, as 'remove' from ``removal`` on. With ``everywhere`` (as in ``sanitise`` and the
    registered query) a term that reveals an entity, judged by the windows of the corpus, is marked in every document
    that holds the entity, however far apart they stand. ``spans`` spells all out, base_sha256 is the
    digest of the base part. A null or empty text has no spans. Counts cover all documents; repeated rows count
    each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    ws = ws or Workspace(docs.sparkSession)
    scanned = scan(docs, window, ws)
    shown = revealing(docs, scanned, threshold, contexts_needed, ws)
    rows = scanned.where("spans is not null").select("doc_id", "row", "digest", "spans", _key("doc_id"))
    key = ["id", "digest"]  # another pass may number rows differently
    places = ws.put(held(docs, shown), "places")
    # Terms to entities first: a term is rare where it reveals many, so few rows arise; then those the document holds.
    near = scanned.where("spans is null").select(_key("doc_id"), "digest", "entity", "term")
    beside = [*key, "entity"] if everywhere else [*key, "entity", "term"]
    holds = near.where("term = ''" if everywhere else "term <> ''").select(*beside)
    shows = places.select(*key, "term").distinct().join(shown, "term").join(holds, beside, "left_semi")
    shows = shows.groupBy(*key, "term").agg(F.max("disclosure").alias("d"))
    marks = places.join(shows, [*key, "term"]).select(*key, "d", F.explode("places").alias("p")).groupBy(*key, "p").agg(
        F.max("d").alias("d"))
    marks = marks.groupBy(*key).agg(F.collect_list(F.struct(
        F.col("p.a").alias("a"), F.when(F.col("d") >= removal, 5).otherwise(4).alias("kind"),
        F.col("p.b").alias("b"))).alias("more"))  # one list per document, no longer than its text
    rows = rows.join(marks, key, "left")
    names = F.array(*[F.lit(k) for k in (*KINDS, "term", "remove")])

    def spell(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["a"].cast("string"), s["b"].cast("string"))), ",")

    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<a:bigint,kind:int,b:bigint>>"))))
    rows = rows.withColumn("every", every)
    return rows.select(
        "doc_id",
        *[_number("spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spell(F.col("spans")), 256).alias("base_sha256"), spell(F.col("every")).alias("spans"),
        F.transform("every", lambda s: F.struct(s["a"].alias("start"), F.get(names, s["kind"]).alias("kind"),
                                                s["b"].alias("end"))).alias("found"), "digest",
    )


def rewritten(text: str, found) -> str:
    """The text with protected values replaced by their kind, 'term' spans generalised to their shape and 'remove'
    spans taken out. Where spans overlap, the one that begins first, of equals the longest, rules."""
    out, at = [], 0
    for start, kind, end in sorted(found, key=lambda s: (s[0], -s[2])):
        if start < at:
            continue
        word = text[start:end]
        shape = "<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<WORD>"
        out += [text[at:start], "" if kind == "remove" else shape if kind == "term" else f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text), one row per row of ``docs``: the texts as ``rewritten`` by what ``find`` finds. Rows are matched
    by doc_id and text digest, so repeated rows come back as often as they were; a null text stays null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find(rows, **{"everywhere": True} | how).where("spans <> ''").dropDuplicates(["doc_id", "digest"])
    clean = F.udf(lambda text, spans: rewritten(text, [tuple(s) for s in spans]) if text and spans else text, "string")
    rows = rows.withColumn("digest", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["digest"] == found["digest"])
    return rows.join(found, same, "left").select(rows["doc_id"], clean("text", "found").alias("text"))
