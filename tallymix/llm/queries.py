"""The operators over the whole tables, and the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.llm import (
    attribution, bitpack, byte_bpe, exact_dedup, hard_negatives, line_crf, merkle, mixing, ngram_join, packing,
    resampling, sanitise, secrets, tokens,
)
from tallymix.llm.common import documents
from tallymix.workspace import Workspace


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_crf.judge(docs, line_crf.train(docs, documents(spark, sf_dir, "labels")))


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.find(documents(spark, sf_dir), everywhere=True).drop("found", "digest")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir)).drop("found")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(documents(spark, sf_dir), n=4, num=85, den=100)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(documents(spark, sf_dir), attribution.title_lead_body(F.col("text")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark).path("token-files")
    bitpack.write_tokens(documents(spark, sf_dir), path, tokens.public_path())
    return bitpack.read_digests(spark, path)


def op10_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    return resampling.resample(docs, resampling.fit(docs, labels), resampling.good_share(labels))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, verified against rows of which some have one character more."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars") + F.when(altered, 1).otherwise(0)
    rows = merkle.verify(merkle.manifest(documents(spark, sf_dir), {"n_chars": n_chars}))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(documents(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_line_crf": op3_line_crf,
    "op4_sanitise": op4_sanitise,
    "op5_secrets": op5_secrets,
    "op6_ngram_join": op6_ngram_join,
    "op7_mixing": op7_mixing,
    "op8_attribution": op8_attribution,
    "op9_token_files": op9_token_files,
    "op10_resampling": op10_resampling,
    "op11_merkle": op11_merkle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        with t as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
            from documents
        ), g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256
        from t join g using (x)""",
    "op7_mixing": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                   ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
            from documents
        ), s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (
            select *, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint]
                   as weight, 3.0::double * source_size as cap
            from s
        ), l as (
            select *, ((sum(source_size::double) over ()) - coalesce(sum(cap) over before, 0))
                      / sum(weight) over rest as level
            from w
            window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding),
                   rest as (order by cap / weight, source nulls last rows between current row and unbounded following)
        ), f as (
            select *, cap <= level * weight as clamped from l
        ), t as (
            select source, source_size, case when clamped then cap
                   else weight * (select arg_min(level, cap / weight) from f where not clamped) end as target
            from f
        ), r as (
            select d.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end
                   as repeats,
                   sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - size as before
            from d join t on d.source is not distinct from t.source
        )
        select doc_id, size, source_size, target,
               (floor(repeats) + case when before + size / 2 < (repeats - floor(repeats)) * source_size
                                      then 1 else 0 end)::bigint as copies,
               (size * copies)::bigint as taken
        from r""",
    "op11_merkle": r"""
        with recursive t as (
            select doc_id, lang, source, n_chars, text, coalesce('=' || lang, '') as tree,
                   list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)) as codes
            from documents
        ), crc as (
            select *, xor(list_reduce([4294967295::bigint] || flatten(list_transform(codes, lambda b: list_transform(range(8),
                      lambda i: ((b >> i) & 1)::bigint))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) as crc
            from t
        ), l as (
            select doc_id, tree, a || (case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end) || b as whole,
                   a || (case when n_chars is null then '-' else strlen((n_chars + d)::varchar) || ':' || (n_chars + d) end) || b as claim
            from (select *, case when crc % 7 = 0 then 1 else 0 end as d,
                         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                         || coalesce(strlen(lang) || ':' || lang, '-') as a,
                         coalesce(strlen(text) || ':' || text, '-') as b from crc)
        ), leaves as (
            select doc_id, tree, sha256(whole) as leaf, sha256(claim) as claimed,
                   row_number() over (partition by tree order by doc_id nulls first, sha256(whole)) - 1 as pos from l
        ), levels as (
            select tree, 0 as level, list(leaf order by pos) as nodes from leaves group by tree
            union all
            select tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
            from levels where len(nodes) > 1
        ), subroots as (
            select tree, nodes[1] as subroot, level as height, row_number() over (order by tree) - 1 as place
            from levels where len(nodes) = 1
        ), tops as (
            select 0 as level, list(subroot order by place) as nodes from subroots
            union all
            select level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
            from tops where len(nodes) > 1
        ), folded as (
            select doc_id, leaf, l.tree, pos, 0 as level, claimed as own, '' as proof from leaves l
            union all
            select f.doc_id, f.leaf, f.tree, f.pos, f.level + 1,
                   sha256(case when n % 2 = 1 then nodes[n] || own else own || coalesce(nodes[n + 2], '') end),
                   proof || case when n % 2 = 1 then nodes[n] else coalesce(nodes[n + 2], '') end
            from (
                select f.*, coalesce(a.nodes, b.nodes) as nodes,
                       (case when a.nodes is not null then pos >> f.level else place >> (f.level - height) end) as n
                from folded f join subroots s using (tree)
                left join levels a on a.tree = f.tree and a.level = f.level and f.level < height
                left join tops b on b.level = f.level - height and f.level >= height and len(b.nodes) > 1
            ) f where nodes is not null
        )
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, own as folded_root, own = root as verified
        from folded join subroots using (tree), (select nodes[1] as root, level as top from tops where len(nodes) = 1)
        where level = height + top""",
    "op13_hard_negatives": r"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)::double) as z
            from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, o.vec_id, a.label = o.label as same, list_inner_product(a.z, o.z)::bigint as score
            from v a join v o on a.vec_id <> o.vec_id where a.vec_id % 100 = 0
        ), p as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        ), n as (
            select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
                   row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
            from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
        )
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
