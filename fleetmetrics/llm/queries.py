"""The registered queries of this subpackage; each is a thin layer over one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import langid, mixing, quality, warc
from .divergence import divergences
from .html_text import extract_pages
from .license_templates import TEMPLATES
from .licenses import digest, scan_licenses
from .near_dedup import NearCopies, near_copies
from .negatives import hard_negatives
from .packing import pack_documents
from .sharding import shard_documents
from .suffix_dedup import removal_digests
from .tables import table
from .topk import top_k

SHARDS = 16


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_weight=1.0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents' domains: toxic, else junk or clean by their quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(
        table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), {"clean": 0.94, "junk": 0.04, "toxic": 0.02},
        iterations=None,
    )
    shares = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(mixed.model.domains)]
    return mixed.rates().select(
        "doc_id", "n_tokens", *shares, "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies")
    )


def op6_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.coalesce("quality", F.lit(0)) == 1
    trusted = good & (F.coalesce("toxic", F.lit(0)) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", good.alias("good"), trusted.alias("trusted"))
    found = quality.judge(table(spark, sf_dir, "documents"), labels)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op8_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages"), min_bytes=0), path)
    found = warc.read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(warc.base32(F.sha1("payload")), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), NearCopies(words=3, percent=85))


def op11_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest(scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_text_density": op2_text_density,
    "op3_rendezvous_sharding": op3_rendezvous_sharding,
    "op4_bin_completion": op4_bin_completion,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_histogram_topk": op6_histogram_topk,
    "op7_ratio_quality": op7_ratio_quality,
    "op8_warc_source": op8_warc_source,
    "op9_language_id": op9_language_id,
    "op10_odd_sketch_dedup": op10_odd_sketch_dedup,
    "op11_cube_divergence": op11_cube_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_template_licenses": op13_template_licenses,
}

OP6_SQL = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as w from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(
    [cast(x as double) for x in q.w], [cast(x as double) for x in c.w]) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
  vec_id, score
from s qualify rank <= 5
"""

OP8_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, octet_length(payload) as payload_bytes, hex,
    translate(concat(
      lpad(to_base(('0x' || hex[1:5])::bigint, 32), 4, '0'), lpad(to_base(('0x' || hex[6:10])::bigint, 32), 4, '0'),
      lpad(to_base(('0x' || hex[11:15])::bigint, 32), 4, '0'), lpad(to_base(('0x' || hex[16:20])::bigint, 32), 4, '0'),
      lpad(to_base(('0x' || hex[21:25])::bigint, 32), 4, '0'), lpad(to_base(('0x' || hex[26:30])::bigint, 32), 4, '0'),
      lpad(to_base(('0x' || hex[31:35])::bigint, 32), 4, '0'), lpad(to_base(('0x' || hex[36:40])::bigint, 32), 4, '0')
    ), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
    min(page_id) over (partition by hex) as first
  from p)
select page_id, payload_bytes, payload_digest,
  case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""

OP11_SQL = """
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
  from documents),
t as (select doc, lang, source, unnest(words) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct doc) >= 10),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source, false as whole from d union all select distinct lang, '', true from d),
c as (
  select lang, source, false as whole, term, count(*) as n from t semi join kept using (lang, term) group by all
  union all
  select lang, '', true, term, count(*) from t semi join kept using (lang, term) group by all),
s as (select lang, source, whole, sum(n) as total from c group by all),
p as (
  select g.lang, g.source, g.whole, k.term, coalesce(c.n, 0) as n,
    (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v))::bigint as p
  from g join kept k using (lang) join v using (lang)
    left join s on s.lang = g.lang and s.source = g.source and s.whole = g.whole
    left join c on c.lang = g.lang and c.source = g.source and c.whole = g.whole and c.term = k.term),
f as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and not a.whole and not b.whole and a.source <> b.source
  group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source and not a.whole and not b.whole
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (
  select a.lang, a.source, a.term as item, ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and not a.whole and b.whole and a.n > 0 and a.p > b.p),
r as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value,
  cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from r qualify part = 'pair' or rank <= 10
"""

OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * cast(x as double)) for x in embedding] as w
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.w, b.w) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""

ORACLES: dict[str, str] = {
    "op6_histogram_topk": OP6_SQL,
    "op8_warc_source": OP8_SQL,
    "op11_cube_divergence": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
