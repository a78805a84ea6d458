"""Registered queries of the subpackage, each applying one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import bpe, compression, exact_dedup, filter_audit, hidden_markov, line_crf, mixing, near_dup, site_tree, spelling, toxicity, url_filter, warc
from claimspark.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tokenizer file of op6 and of the pipeline's last stage.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    return records.select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        warc.page_id_of(F.col("refers_to")).alias("refers_to"),
    )


SQL["op2_warc"] = r"""
with p as (
  select page_id, coalesce(html, '') as html from pages
), h as (
  select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as first from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from h
"""


@query
def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"))


@query
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op7_exact_dedup"] = r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from n window g as (partition by text_sha256)
"""

@query
def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract_text(table(spark, sf_dir, "pages"))


#: Host and path of the contract's rules; `com/` is every host under `com`.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def reported_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of op8: URLs of pages whose document `labels` marks as toxic or of low quality.

    A page shows the document whose number ends its path.
    """
    number = F.expr("try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(\\\\.html)?/?([?#]|$)', 1) as bigint)")
    pages = table(spark, sf_dir, "pages").select("url", number.alias("doc_id"))
    marked = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").select("doc_id").distinct()
    return pages.join(marked, "doc_id", "left_semi").select("url")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), reported_urls(spark, sf_dir), RULES)


SQL["op8_url_filter"] = r"""
with p as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), c as (
  select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/+|\.html?)\z', '') as canonical from p
), listed as (
  select distinct canonical from c
  where canonical <> '' and try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(\.html)?/?([?#]|$)', 1) as bigint)
    in (select doc_id from labels where toxic = 1 or quality = 0)
), rules(verdict, host, path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit as (
  select c.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from c join rules r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
  group by c.page_id
)
select c.page_id, c.host, c.path, f.rule, l.canonical is not null as listed,
  coalesce(f.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict
from c left join fit f on f.page_id = c.page_id left join listed l on l.canonical = c.canonical
"""


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op10_source_mix"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as place from d group by source
), w as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as top from s
), b as (
  select *, (sum(source_size) over () - coalesce(sum(top) over lower_ones, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over lower_ones, 0))::double as level
  from w window lower_ones as (order by top::double / weight, source is null, source rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, least(top::double, weight * max(level) over ()) as target from b
), p as (
  select *, coalesce(floor(target / source_size), 0)::bigint as certain from t
), q as (
  select *, target - certain * source_size as rest from p
), u as (
  select d.doc_id, d.size, q.source_size, q.target, q.certain, q.rest, q.source, q.rest / q.source_size as share,
    (('0x' || substr(md5('20:' || d.doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as x
  from d join q on d.source is not distinct from q.source
), r as (
  select *, case when size > 0 and rest > 0 then x / (1.0 - x) / (share / (1.0 - share) * sqrt(size::double)) end as rank from u
), c as (
  select *, coalesce(sum(size) over (partition by source order by rank nulls last, doc_id rows between unbounded preceding and 1 preceding), 0) as before from r
)
select doc_id, size, source_size, target,
  cast(size * (certain + case when rank is not null and before + size / 2.0 < rest then 1 else 0 end) as bigint) as taken
from c
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), f as (
  select doc_id, part, min(doc_id) over (partition by text) < doc_id as e, len(words) < 200 as a,
    100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d
  from w
), m as (
  select part, (a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * coalesce(e, false)::int) as fails,
    doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic
  from f
), cells as (
  select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by part, fails
), l(letter, bit) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select v.letter || w.letter || x.letter || y.letter || z.letter as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
  from l v, l w, l x, l y, l z
  where v.bit | w.bit | x.bit | y.bit | z.bit = 31
), steps as (
  select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
  from orders, unnest(range(1, 6)) as s(step)
)
select part, filter_order, step,
  coalesce(sum(n) filter (where fails & (own | earlier) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where fails & own <> 0 and fails & earlier = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where fails & own <> 0 and fails & earlier <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where fails = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where fails & own <> 0 and fails & earlier = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where fails & own <> 0 and fails & earlier = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(fails), 1)) filter (where fails & own <> 0), 0)::bigint as shapley
from cells, steps
group by part, filter_order, step
"""


@query
def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, sf_dir, "documents"))


def load() -> tuple[dict, dict]:
    return QUERIES, SQL
