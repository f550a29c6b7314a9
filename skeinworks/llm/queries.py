"""The corpus operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import bpe, collocations, exact_dedup, language_id, line_dedup, lm_score, media, mixing, simhash_dedup, suffix_dedup, token_files, warc, whitening

#: The vocabulary that the queries encode with; other paths are a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    n_dropped = F.size("dropped").cast("long")
    return lines.select("doc_id", "n_lines", n_dropped.alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())
    return token_files.read_tokens(shards).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media": op1_media,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_lm_score": op6_lm_score,
    "op7_bpe": op7_bpe,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

OP5_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source
), ranked as (
  select *, (case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight, 2.0::double * source_size as cap from totals
), filled as (
  -- what all sources take together when each takes `level` by weight up to its cap, at each level at which one is full
  select l.cap / l.weight as level, sum(least(r.cap, l.cap / l.weight * r.weight)) as takes from ranked l, ranked r group by l.place, 1
), below as (
  select coalesce(max(level), 0) as level, coalesce(max_by(takes, level), 0) as takes from filled where takes <= 1.5::double * (select sum(source_size) from ranked)
), targets as (
  select source, source_size, least(cap, (b.level + (1.5::double * (select sum(source_size) from ranked) - b.takes)
    / (select nullif(sum(weight), 0) from ranked where cap / weight > b.level)) * weight) as target from ranked, below b
), placed as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('42:' || (s.source is not null)::varchar || ':' || coalesce(s.source, '')), 1, 8))::bigint / 4294967296.0::double as off,
    row_number() over (partition by s.source order by length(bin(s.size)),
      ('0x' || substr(md5(coalesce(s.doc_id::varchar, '')), 1, 8))::bigint % ceil(sqrt((select count(*) from sized) / 8.0))::bigint, s.size, s.doc_id nulls first) as k
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (floor(rate * k + off) - floor(rate * (k - 1) + off))::bigint * size as taken
from placed
"""

OP9_SQL = r"""
with b as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256, row_number() over () as r from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256)::bigint as group_size,
  row_number() over w = 1 as kept, text_sha256
from b window w as (partition by text_sha256 order by chars desc, doc_id nulls last, r rows between unbounded preceding and unbounded following)
"""

OP10_SQL = r"""
with d as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as s from pages
), w as (
  select *, max(page_id) over (partition by s) as best from d
)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 40, 5), lambda k: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (k + 1)::int, 5))::bigint >> b) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type,
  case when page_id = best then null else best end as refers_to
from w
"""

OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as piece,
    regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
  from documents
), grams as (
  select lang, ws, unnest(range(1, len(ws) + 1)) as i from pieces
), patterns as (
  select lang, p, count(*) as f from (select lang, unnest([ws[i:i], case when i + 1 <= len(ws) then ws[i:i + 1] end, case when i + 2 <= len(ws) then ws[i:i + 2] end]) as p from grams)
  where p is not null group by lang, p
), totals as (
  select lang, sum(f)::bigint as n from patterns where len(p) = 1 group by lang
), candidates as (
  select lang, p, f as a from patterns where len(p) >= 2 and f >= 10
), cuts as (
  select c.lang, c.p, c.a, k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, len(p))) as k from candidates) c
  join patterns x on x.lang = c.lang and x.p = c.p[1:k] join patterns y on y.lang = c.lang and y.p = c.p[k + 1:]
), scored as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1
), inside as (
  select lang, p, max(a) as longer from (select lang, a, unnest([p[1:2], p[2:3]]) as p from candidates where len(p) = 3) group by lang, p
), kept as (
  select s.lang, array_to_string(s.p, ' ') as phrase, a, l, r, score::bigint as score
  from scored s left join inside i on i.lang = s.lang and i.p = s.p where longer is null or 100 * longer < 50 * a
)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from kept k join totals t on t.lang = k.lang qualify rank <= 2000
"""

ORACLE_SQL = {"op5_mixing": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op13_collocations": OP13_SQL}
