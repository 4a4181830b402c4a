"""The opN queries and their oracle SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import centroids, chat, decontaminate, divergence, huffman, langid, ngram_join, packing, pagetext, quality, repetition, revisits, runindex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, Fraction(85, 100))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of all pages: each page is fetched in full, then asked for again twice; the second time some servers say
    'not modified' with a weak ETag, some with the ETag of another version, and some with none. Some records are logged twice."""
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") + F.lit(k * 10_000_000))
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    one = pages.select(
        (F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("record_type"), "url", at(0).alias("at"), F.lit(200).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), at(0).cast("string")).alias("headers"), F.col("html").alias("body"),
    )
    again = lambda rows, k, etag: rows.select(
        (F.col("page_id") * 3 + k).alias("record_id"), F.lit("revisit").alias("record_type"), F.concat("url", F.lit("#again")).alias("url"), at(k).alias("at"), F.lit(304).alias("status"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("etag"), F.coalesce(etag, F.lit("")), F.lit("Date"), at(k).cast("string"), F.lit("Server"), F.lit("cache")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    weak = F.concat(F.lit("W/"), tag)
    other = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).when(F.col("page_id") % 5 != 1, tag)
    twice = again(pages.filter("page_id % 11 = 3"), 1, weak)
    return one.unionByName(again(pages, 1, weak)).unionByName(again(pages, 2, other)).unionByName(twice)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    header = lambda k: F.element_at("headers", k)
    return out.select("record_id", "url_key", "outcome", "base_id", "status", F.coalesce(header("etag"), header("ETag")).alias("etag"), header("Date").alias("date"), header("Server").alias("server"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    out = quality.classify(table(spark, sf_dir, "documents"), labels, "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(runindex.remove_repeats(table(spark, sf_dir, "documents")))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.digests(spark, huffman.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.md5(F.col("chat").cast("binary")).alias("chat_md5"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.filter(remainder(4) != 2).select("lang", "text")
    return langid.identify(docs, training).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "fit")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_packing, op4_warc_revisits, op5_quality_classifier, op6_decontamination, op7_suffix_dedup, op8_huffman_ids, op9_chat_snapshots, op10_language_id, op11_html_extraction, op12_centroid_clustering, op13_source_divergence)}

_CANON = r"""
  regexp_replace(lower(regexp_replace(regexp_extract(u, '^[^/?]*'), ':(80|443)$', '')), '^www[.]', '')
  || regexp_replace(regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^[^?]*'), '\.html$', ''), '/+$', '')
  || case when q <> '' then '?' || q else '' end"""

def _lloyd(rounds: int = 3, k: int = 16) -> str:
    """Lloyd's rounds in SQL, every distance of every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (
  select x.row, x.vec_id, x.v, c.c, cast(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from kept x cross join c{r} c
), a{r} as (
  select row, any_value(vec_id) as vec_id, any_value(v) as v, cast(min(d) as bigint) as d, arg_min(c, (d, c)) as c from d{r} group by row
)""")
        if r < rounds:
            steps.append(f"""s{r} as (
  select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from a{r}) group by c, i
), m{r} as (
  select c, list(cast((s - ((s % n + n) % n)) // n as bigint) order by i) as v from s{r} group by c
), c{r + 1} as (
  select c{r}.c, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (c)
)""")
    return f"""
with kept as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from kept where vec_id is not null qualify c < {k}
), {", ".join(steps)}
select vec_id, cast(a{rounds}.c as integer) as cluster, d as distance, cast(sum(d) over (partition by a{rounds}.c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on a{rounds}.c = c{rounds}.c"""


#: White space as str.split() has it.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

ORACLES = {
    # Right for pages like these, whose main text is all of one article element: the model is held to it, not made by it.
    "op11_html_extraction": rf"""
with articles as (
  select row_number() over () as row, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as a from pages
), blocks as (
  select row, unnest(string_split_regex(a, '</?(p|h1)>')) as b, generate_subscripts(string_split_regex(a, '</?(p|h1)>'), 1) as i from articles
), plain as (
  select row, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') as b from blocks
), clean as (
  select row, i, trim(regexp_replace(b, '{_WHITE}', ' ', 'g')) as b from plain
), texts as (
  select row, string_agg(b, chr(10) order by i) as text from clean where b <> '' group by row
)
select page_id, url, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from articles left join texts using (row)""",
    "op12_centroid_clustering": _lloyd(),
    "op13_source_divergence": r"""
with d as (
  select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), w as (
  select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as n from w group by lang, term having count(distinct row) >= 30
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), c as (
  select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term
), g as (
  select lang, source, coalesce(sum(c.n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by lang, source
), p as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
    cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v) as bigint) as p,
    cast(1 + (1000000000::hugeint * (kept.n + 5)) // (langs.total + 5 * v) as bigint) as q
  from g join kept using (lang) join langs using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
), far as (
  select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source
  union all
  select lang, source, 'term', term, p - q from p where n > 0 and p > q
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from parts qualify part = 'pair' or rank <= 50""",
    "op4_warc_revisits": rf"""
with records as (
  select page_id * 3 as record_id, 'response' as kind, url, 1700000000 + page_id as s, '"' || md5(html) || '"' as etag, html as body, 1 as copy from pages
  union all
  select page_id * 3 + 1, 'revisit', url || '#again', 1710000000 + page_id, 'W/"' || md5(html) || '"', null, unnest(case when page_id % 11 = 3 then [1, 2] else [1] end) from pages
  union all
  select page_id * 3 + 2, 'revisit', url || '#again', 1720000000 + page_id, case page_id % 5 when 0 then '"stale"' when 1 then null else '"' || md5(html) || '"' end, null, 1 from pages
), cleaned as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from records
), queried as (
  select *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '\?(.*)$', 1), '(^|&)(utm_[a-z]*|ref|sessionid)=[^&]*', '', 'g'), '^&', '') as q from cleaned
), keyed as (
  select *, {_CANON} as url_key from queried
), ranked as (
  select v.record_id, v.copy, b.record_id as base_id, b.etag as base_etag, b.body as base_body,
    row_number() over (partition by v.record_id, v.copy order by b.s desc, b.record_id desc) as k
  from keyed v join keyed b on v.url_key = b.url_key and b.kind = 'response' and b.s < v.s where v.kind = 'revisit'
), joined as (
  select r.*, b.base_id, b.base_body, regexp_replace(r.etag, '^W/', '') = b.base_etag as good
  from keyed r left join ranked b on r.record_id = b.record_id and r.copy = b.copy and b.k = 1
)
select record_id, url_key,
  case when kind = 'response' then 'full' when good then 'resolved' when base_id is null then 'no_base' when good is null then 'unverified' else 'validator_mismatch' end as outcome,
  case when good then base_id end as base_id,
  case when kind = 'response' or good then 200 end as status,
  coalesce(etag, '') as etag, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') as date,
  case when kind = 'revisit' and not coalesce(good, false) then 'cache' end as server,
  case when kind = 'response' then md5(body) when good then md5(base_body) end as body_md5
from joined""",
    "op9_chat_snapshots": r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), placed as (
  select *, row_number() over w as place, lead(turn) over w is null and row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) = 1 as last,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') over w as chat
  from turns window w as (partition by conv_id order by turn nulls first, role, text)
), whole as (
  select place, chat, min(conv_id) as conv_id from placed where last group by place, chat
)
select conv_id, place as n_turns, length(chat) as n_chars, md5(chat) as chat_md5 from whole w
where not exists (select 1 from placed p where not p.last and p.place = w.place and p.chat = w.chat)""",
}
