"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import (
    fill_in_middle, gif, importance, jaccard_join, mixing, packing, pii, quality_gbt, quality_rules_ensemble, sharding, substring_dedup, url_filters, warc,
)

#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the sparse rule ensemble."""
    return quality_rules_ensemble.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents by the boosted trees."""
    return quality_gbt.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page by the fixed rules."""
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in all documents."""
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of all documents, 8 buckets and 65,536 tokens a batch."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot and place in the mixed order of all documents; a source weighs the root of its size."""
    return mixing.mixed_order(_table(spark, sf_dir, "documents"))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, written, read back and described."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of all documents."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF, read back into timed frames and described."""
    return gif.round_trip(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from all documents as parts of repeated windows, and the digest of the rest."""
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents, 16 shards of nearly equal bytes."""
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents, drawn towards the benchmark's texts."""
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form and cuts of all documents, and digests of the outputs and of the texts rebuilt from them."""
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) as path
  from u
), r(rh, rp, v) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select page_id, host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
  from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  group by all
)
select h.page_id, coalesce(h.host, '') as host, coalesce(h.path, '') as path, best.rule, coalesce(best.v, 'allow') as verdict
from h left join best on h.page_id = best.page_id
"""

OP10_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select r, unnest(range(1, greatest(len(w) - 34, 0) + 1)) as i, w from d
), g as (
  select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from s
), rep as (
  select r, i from g qualify count(*) over (partition by h) > 1
), gone as (
  select distinct r, unnest(range(i, i + 35)) as i from rep
), kept as (
  select d.r, list(x.word order by x.i) filter (gone.r is null) as k, count(gone.r) as n_removed
  from d, unnest(d.w) with ordinality as x(word, i) left join gone on gone.r = d.r and gone.i = x.i
  group by d.r
)
select d.doc_id, len(d.w) as n_words, coalesce(kept.n_removed, 0) as n_removed,
       sha256(coalesce(array_to_string(kept.k, ' '), '')) as kept_sha256
from d left join kept on kept.r = d.r
"""

OP5_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents
), s as (
  select distinct r, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), n as (
  select r, count(*) as n from s group by r
), pairs as (
  select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by all
), links as (
  select x, y from pairs join n nx on nx.r = x join n ny on ny.r = y where 100 * c >= 75 * (nx.n + ny.n - c)
), reach(x, y) as (
  select r, r from d union select reach.x, links.y from reach join links on links.x = reach.y
), comp as (
  select reach.x, min(e.doc_id) as component_id from reach join d e on e.r = reach.y group by reach.x
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, comp.component_id from d left join n on n.r = d.r join comp on comp.x = d.r
"""

OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256(concat('1:', doc_id)) as h
  from documents
), x as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from x
), p as (
  select doc_id, n, form, t, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rule_ensemble": op1_quality_rule_ensemble,
    "op2_length_buckets": op2_length_buckets,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op7_warc_dictionary": op7_warc_dictionary,
    "op3_quality_gbt": op3_quality_gbt,
    "op6_url_filters": op6_url_filters,
    "op8_gif_media": op8_gif_media,
    "op9_pii_anchors": op9_pii_anchors,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sampled_splitters": op11_sampled_splitters,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op6_url_filters": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op13_fill_in_middle": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
