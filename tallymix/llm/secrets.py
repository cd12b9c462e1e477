"""Secrets: fixed patterns, and tokens that pass a battery of randomness tests. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymix.workspace import Workspace

KINDS = ("assign", "access", "hex")
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""")
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_IN = "A-Za-z0-9+/_-"
# '=' is padding at the end only; what stands after it, as in name=value, is a candidate of its own.
_PLAIN = r"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++|[+/_-]++)"
# Eight characters are the least that the battery tests. Tokens of one class, like words, are no candidates.
CANDIDATE = rf"(?<![{_IN}])(?!{_PLAIN}(?![={_IN}]))[{_IN}]{{8,}}+(?:={{1,2}}+(?![{_IN}]))?"
ORDINARY = rf"(?<![{_IN}])(?:[A-Z]?[a-z]{{7,}}+|[A-Z]{{8,}}+)(?![{_IN}])"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {  # in order of inference; '-' and '_' are read as '+' and '/'
    "base16": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
STRATA = (8, 10, 12, 14, 16, 18, 20, 24, 32, 48, 96)  # least lengths; each stratum has its own control of false discoveries
LONG = 15
BINS = 1000


def _with(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ends(lengths: Column) -> Column:
    """Running sums of an array, in blocks of about the square root of its size: a sum appends to its own block only,
    since an append copies the array it extends."""
    none = F.array().cast("array<bigint>")

    def running(block):
        return F.aggregate(block, F.array(F.lit(0).cast("bigint")), lambda acc, v: F.concat(
            acc, F.array(F.element_at(acc, -1) + v)))  # one more than the block has: begins with 0

    def whole(x):
        step = F.ceil(F.sqrt(F.size(x))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(x), step)
        blocks = F.transform(firsts, lambda i: running(F.slice(x, i, step)))
        return _with(blocks, lambda bs: F.flatten(F.zip_with(
            bs, running(F.transform(bs, lambda b: F.element_at(b, -1))),
            lambda b, before: F.transform(F.slice(F.coalesce(b, none), 2, step), lambda v: v + before))))

    return _with(lengths, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def _found(text: Column, pattern: str) -> Column:
    """(a, b, hit) of the leftmost non-overlapping matches. Each match is taken with the gap before it, anchored at the
    end of the last one, so that lengths give places and a text is gone through once."""
    both = rf"\G((?s:.*?))({pattern})"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("gap"),
                         F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("hit"))
    spans = _with(parts, lambda ps: F.zip_with(
        ps, _ends(F.transform(ps, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint"))),
        lambda p, b: F.struct((b - F.length(p["hit"])).alias("a"), b.alias("b"), p["hit"].alias("hit"))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,hit:string>>"))


def base_spans(text: Column) -> Column:
    """(a, kind, b) of the fixed patterns, in order."""
    assign = F.filter(_found(text, ASSIGN + VALUE), lambda s: F.length(
        F.regexp_extract(s["hit"], ASSIGN + f"({VALUE})", 1)) >= 8)

    def as_kind(spans, kind):
        return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.lit(kind).alias("kind"), s["b"].alias("b")))

    return F.array_sort(F.concat(as_kind(assign, 0), as_kind(_found(text, ACCESS), 1), as_kind(_found(text, HEX), 2)))


def inferred(token: Column) -> Column:
    """The encoding of a token: the smallest alphabet that has all its characters and cases."""
    return (F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "base16").when(token.rlike(r"^[A-Z2-7]+=*$"), "base32")
            .when(token.rlike(r"^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64"))


def _upper_tail(z: Column) -> Column:
    """Of the normal distribution, by a logistic curve that is off by less than 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds p_random to (token, encoding): how well the token fits uniform independent draws from the alphabet.

    Three p-values are combined by Fisher's sum of logarithms: chi-squared for equal counts of the letters (cube root
    approximation), runs of the lower and the upper half of the alphabet, and the correlation of neighbours. A token
    with a character outside the alphabet gets 0.
    """
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[F.col("encoding")]
    plain = F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")
    plain = F.when(F.col("encoding").isin("base16", "base36"), F.lower(plain)).when(
        F.col("encoding") == "base32", F.upper(plain)).otherwise(plain)
    t = tokens.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet").cast("double"))
    t = t.withColumn("x", F.transform(F.filter(F.split(plain, ""), lambda c: c != ""),
                                      lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    t = t.withColumn("n", F.size("x").cast("double")).withColumn("mean", _over(F.aggregate(
        "x", F.lit(0.0), lambda a, v: a + v), F.col("n")))
    # Uniformity.
    squares = F.aggregate(F.sequence(F.lit(0), F.col("k").cast("int") - 1), F.lit(0.0), lambda a, v: a + F.pow(
        F.size(F.filter("x", lambda c: c == v)).cast("double"), F.lit(2.0)))
    t = t.withColumn("chi", _over(F.col("k") * squares, F.col("n")) - F.col("n"))
    free = F.col("k") - 1
    uniform = _upper_tail((F.cbrt(F.col("chi") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    # Runs.
    before, after = F.expr("slice(x, 1, greatest(size(x) - 1, 0))"), F.expr("slice(x, 2, greatest(size(x) - 1, 0))")
    high = F.size(F.filter("x", lambda c: c >= F.col("k") / 2)).cast("double")
    turns = F.size(F.filter(F.zip_with(before, after, lambda a, b: (a >= F.col("k") / 2) != (b >= F.col("k") / 2)),
                            lambda v: v)).cast("double")
    t = t.withColumn("high", high).withColumn("runs", turns + 1)
    mean_runs = _over(2 * F.col("high") * (F.col("n") - F.col("high")), F.col("n")) + 1
    variance = _over((mean_runs - 1) * (mean_runs - 2), F.col("n") - 1)
    off = _over(F.abs(F.col("runs") - mean_runs), F.sqrt(F.greatest(variance, F.lit(0.0))))
    runs = F.coalesce(2 * _upper_tail(off), F.lit(0.0))
    # Serial correlation.
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    lagged = F.aggregate(F.zip_with(before, after, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0),
                         lambda a, v: a + v)
    z = (_over(lagged, total) + _over(F.lit(1.0), F.col("n"))) * F.sqrt("n")
    serial = F.coalesce(2 * _upper_tail(F.abs(z)), F.lit(0.0))
    half = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in (uniform, runs, serial)), F.lit(0.0))
    t = t.withColumn("half", half)
    p = F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)
    fits = ~F.exists("x", lambda v: v < 0) & (F.col("n") >= 8)
    return t.withColumn("p_random", F.when(fits, p).otherwise(0.0)).select(*tokens.columns, "p_random")


def thresholds(tested: DataFrame, ordinary: DataFrame, q: float) -> DataFrame:
    """(stratum, encoding, lowest): the least bin of p_random from which tokens count as discoveries.

    ``ordinary`` (length, encoding, bin) are words of the same texts under the same alphabets. A token's p-value is
    the share of ordinary words that look at least as random: twice the lesser of the share in its stratum and the
    share in its stratum and all shorter ones of LONG letters, which are more in number and look more random. In each stratum of ``tested`` (stratum, encoding, bin) the
    Benjamini-Hochberg rule at ``q`` picks the discoveries. All is done on counts by bin, a table of fixed size.
    """
    # A word counts in its own stratum and, from LONG letters on, in all longer ones; shorter words look too random.
    reach = F.array(*[F.lit(s) for s in STRATA])
    tops = [*STRATA[1:], 1 << 30]
    top = F.create_map(*[F.lit(x) for s, t in zip(STRATA, tops) for x in (s, t)])
    words = ordinary.groupBy("length", "encoding", "bin").agg(F.count("*").alias("c"))
    words = words.select("*", F.explode(reach).alias("stratum")).where(
        (F.col("length") < top[F.col("stratum")]) & (F.col("length") >= F.least("stratum", F.lit(LONG))))
    own = F.sum(F.when(F.col("length") >= F.col("stratum"), F.col("c")).otherwise(0)).alias("own")
    words = words.groupBy("stratum", "encoding", "bin").agg(F.sum("c").alias("ordinary"), own)
    found = tested.groupBy("stratum", "encoding", "bin").agg(F.count("*").alias("tested"))
    both = found.join(words, ["stratum", "encoding", "bin"], "full").fillna(0, ["ordinary", "own", "tested"])
    down = Window.partitionBy("stratum", "encoding").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "encoding")
    shares = [(1 + F.sum(c).over(down)) / (1 + F.sum(c).over(whole)) for c in ("ordinary", "own")]
    both = both.withColumn("p", F.least(F.lit(1.0), 2 * F.least(*shares)))
    # In a stratum, by rising p: as many tokens have a p-value up to this.
    rank = F.sum("tested").over(Window.partitionBy("stratum").orderBy("p"))
    passes = F.col("p") * F.sum("tested").over(Window.partitionBy("stratum")) <= q * rank
    both = both.withColumn("limit", F.max(F.when(passes, F.col("p"))).over(Window.partitionBy("stratum")))
    return both.where(F.col("p") <= F.col("limit")).groupBy("stratum", "encoding").agg(F.min("bin").alias("lowest"))


def _number(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, q: float = 0.05, alpha: float = 0.01, ws: Workspace | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` lists (start, kind, end) in code points of the fixed patterns and of the tokens, kind 'random', that no
    pattern covers, whose p_random is at least ``alpha`` and which the false-discovery control of their length
    accepts; ``spans`` spells all out, base_sha256 is the digest of the fixed part. A null or empty text has none.
    Repeated rows give equal rows; an empty table an empty result. Other columns are ignored, whatever their names.
    """
    ws = ws or Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    scanned = scanned.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), base_spans(F.col("text")).alias("spans"),
        _found(F.col("text"), CANDIDATE).alias("tokens"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("words"))
    scanned = ws.put(scanned, "scanned")
    tokens = scanned.select("row", F.explode("tokens").alias("t"), "spans").where(
        ~F.exists("spans", lambda s: (s["a"] < F.col("t.b")) & (F.col("t.a") < s["b"])))
    tokens = tokens.select("row", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.hit").alias("token"))
    plain = F.col("token").rlike(rf"^{_PLAIN}$|^[+/_=-]+$")
    tokens = tokens.where(~plain).withColumn("encoding", inferred(F.col("token")))
    stratum = F.greatest(*[F.when(F.length("token") >= s, F.lit(s)) for s in STRATA], F.lit(STRATA[0]))
    grade = F.floor(F.col("p_random") * BINS).cast("int").alias("bin")
    tested = ws.put(battery(tokens).select("row", "a", "b", "encoding", "p_random", stratum.alias("stratum"), grade), "tested")
    # A word that many texts have counts once.
    words = scanned.select(F.explode("words").alias("token")).distinct()
    words = words.select("token", F.explode(F.array(*[F.lit(e) for e in ALPHABETS])).alias("encoding"))
    ordinary = battery(words).select(F.length("token").alias("length"), "encoding", grade)
    lowest = thresholds(tested, ordinary, q)  # at most one row per stratum and encoding
    secret = tested.join(F.broadcast(lowest), ["stratum", "encoding"]).where(
        (F.col("p_random") >= alpha) & (F.col("bin") >= F.col("lowest")))
    more = secret.groupBy("row").agg(F.collect_list(F.struct("a", F.lit(3).alias("kind"), "b")).alias("more"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])

    def spell(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["a"].cast("string"), s["b"].cast("string"))), ",")

    rows = scanned.select("doc_id", "row", "spans").join(more, "row", "left")
    rows = rows.withColumn("every", F.array_sort(F.concat("spans", F.coalesce(
        "more", F.array().cast("array<struct<a:bigint,kind:int,b:bigint>>")))))
    return rows.select(
        "doc_id",
        *[_number("spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spell(F.col("spans")), 256).alias("base_sha256"), spell(F.col("every")).alias("spans"),
        F.transform("every", lambda s: F.struct(s["a"].alias("start"), F.get(names, s["kind"]).alias("kind"),
                                                s["b"].alias("end"))).alias("found"),
    )
