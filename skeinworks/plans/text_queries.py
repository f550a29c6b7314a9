"""Queries on names, code, strings, documents and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import features, names, texts
from skeinworks.functions.catalog import CATEGORIES, DANGEROUS
from skeinworks.operators import retrieval
from skeinworks.operators.keyword_index import KeywordIndex
from skeinworks.operators.vector_index import VectorIndex
from skeinworks.sources.tables import table

#: Names as they come from binaries, beside those of the tables.
SAMPLES = ("__imp__recv@16", "___main", "WS2_32.dll::send", "KERNEL32.DLL_WSARecvFrom", "thunk_foo", "Class::FUN_00401000", "j_x", "_", "@12", "a1", "param_3", "sub_401000", "<EXTERNAL>::open", "__imp_", "uVar12", "DAT_0040a0")
QUERY = "the tion and haer"
LINES = "\n"
#: All calls of the catalogue.
CALLS = sorted({n for s in [*CATEGORIES.values(), *DANGEROUS.values()] for n in s})


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer", "c_name").select(F.col("c_name").alias("name"))
    named = named.union(table(spark, sf_dir, "supplier", "s_name")).union(table(spark, sf_dir, "part", "p_name")).distinct()
    return named.union(spark.createDataFrame([(n,) for n in SAMPLES], "name string"))


def normalize_names(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("name", names.api_name(n).alias("api"), names.external_name(n).alias("external_"), names.thunk_name(n).alias("thunk"), names.library_name(n).alias("library"))


def default_name_filter(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("name", names.is_default(n).alias("is_default"), names.suggests_network(n).alias("network"), names.suggests_file(n).alias("file"))


def hex_addresses(spark, sf_dir):
    """Addresses as hex text and back."""
    keys = table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))).alias("address"))
    return keys.select("o_orderkey", "address", names.hex_address(F.col("address")).alias("back"))


def extract_calls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", F.array_join(features.called_names(F.col("html")), ",").alias("calls"))


def classify_strings(spark, sf_dir):
    """Kinds of the words of all documents and of the pages' URLs."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("value"))
    values = words.union(table(spark, sf_dir, "pages", "url")).groupBy("value").agg(F.count("*").alias("n"))
    return values.select("value", "n", features.string_kind(F.col("value")).alias("kind")).filter("kind is not null")


def activity_profile_risk(spark, sf_dir):
    """Features, profile, risk and flags of every document and page, taken as code with strings."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("code"))
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").select(F.concat(F.lit("p"), "page_id").alias("id"), F.concat("url", F.lit("\n"), "html").alias("code"))
    f = docs.union(pages).select("id", features.called_names(F.col("code")).alias("calls"), F.split("code", r"[\x20\x09-\x0D]+").alias("words"))
    kinds = {"ips": "ip", "urls": "url", "domains": "domain", "paths": "path", "registry": "registry"}
    f = f.select("id", features.known_calls(F.col("calls")).alias("calls"), features.kinds_of(F.col("words")).alias("strings"))
    f = f.withColumns(features.api_columns(F.col("calls")))
    of_kind = lambda kind: F.transform(F.filter("strings", lambda x: x["kind"] == kind), lambda x: x["word"])
    f = f.withColumns({k: of_kind(kind) for k, kind in kinds.items()})
    c = {k: F.col(k) for k in [*CATEGORIES, "risks", *kinds]}
    f = f.withColumn("profile", features.profile(*(c[k] for k in CATEGORIES))).withColumn("score", features.risk_score(c))
    f = f.withColumn("level", features.risk_level(F.col("score")))
    return f.select("id", "profile", "score", "level", F.array_join(features.security_flags(c, F.col("profile"), F.col("level")), ",").alias("flags"))


def catalog_profile_risk(spark, sf_dir):
    """As activity_profile_risk for parts as functions that call two functions of the catalogue each."""
    names_ = F.array(*map(F.lit, CALLS))
    nth = lambda n: F.get(names_, F.pmod(n, F.lit(len(CALLS))).cast("int"))
    cases = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", nth(F.col("p_partkey")).alias("a"), nth(F.col("p_partkey") + F.col("p_size")).alias("b"))
    f = cases.select("p_partkey", F.array_sort(F.array("a", "b")).alias("calls")).withColumns(features.api_columns(F.col("calls")))
    none = F.array().cast("array<string>")
    c = {k: F.col(k) for k in [*CATEGORIES, "risks"]} | {k: none for k in ("ips", "urls", "domains", "paths", "registry")}
    f = f.withColumn("profile", features.profile(*(c[k] for k in CATEGORIES))).withColumn("score", features.risk_score(c))
    f = f.withColumn("level", features.risk_level(F.col("score")))
    return f.select("p_partkey", "profile", "score", "level", F.array_join("risks", ",").alias("risks"), F.array_join(features.security_flags(c, F.col("profile"), F.col("level")), ",").alias("flags"))


def complexity(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", *[c.alias(k) for k, c in features.complexity(F.col("html")).items()])


def category_keywords(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", texts.summary_category(t).alias("category"), F.array_join(texts.keywords(t), " ").alias("keywords"), texts.truncated(t, 60).alias("short"))


def truncations(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(texts.truncated_middle(t, 200)).alias("middle"), F.md5(texts.truncated_at_line(t, 800)).alias("at_line"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


def chunk_documents(spark, sf_dir):
    found = retrieval.chunks(_files(spark, sf_dir), "doc_id", "text", LINES)
    return found.select("doc_id", "chunk_id", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def chunk_stats(spark, sf_dir):
    """Chunks per document and their lengths."""
    found = retrieval.chunks(_files(spark, sf_dir), "doc_id", "text", LINES)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content").cast("long")).alias("n_chars"))


def bm25_search(spark, sf_dir):
    found = retrieval.bm25(_files(spark, sf_dir), "doc_id", "text", QUERY)
    return retrieval.top(found.select("doc_id", F.round("score", 6).alias("score"), F.round("saturated", 6).alias("saturated")), "score", 15, "doc_id")


def bm25_scores(spark, sf_dir):
    """The score of every document that matches."""
    found = retrieval.bm25(_files(spark, sf_dir), "doc_id", "text", QUERY)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def term_postings(spark, sf_dir):
    """Documents and occurrences of each term: the inverted index, summed up."""
    found = retrieval.postings(_files(spark, sf_dir), "doc_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def keyword_index_search(spark, sf_dir):
    """The best documents, from an index in files of which the query's terms are read."""
    found = KeywordIndex.build(_files(spark, sf_dir), "doc_id", "text").search(QUERY, 15)
    return found.select(F.col("id").alias("doc_id"), "score", F.round("saturated", 6).alias("saturated"))


def _kept_up(spark, sf_dir):
    """An index of all documents after changes: the benchmark's texts come, German documents end in one more word, toxic ones go."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    index = KeywordIndex.build(docs, "doc_id", "text")
    index.apply(table(spark, sf_dir, "benchmark", "item_id", "text").select((-1 - F.col("item_id")).alias("id"), "text"))
    toxic = table(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    index.apply(docs.filter("lang = 'de'").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" haer")).alias("text")), toxic)
    index.apply(None, toxic)  # what is gone already
    return index


def keyword_index_upkeep(spark, sf_dir):
    """The best documents of an index after inserts, edits and deletes."""
    found = _kept_up(spark, sf_dir).search(QUERY, 15)
    return found.select(F.col("id").alias("doc_id"), "score", F.round("saturated", 6).alias("saturated"))


def keyword_index_terms(spark, sf_dir):
    """Document frequencies of an index after inserts, edits and deletes, its generations merged."""
    index = _kept_up(spark, sf_dir)
    index.merge()
    return index.terms()


def snippets(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", texts.snippet(F.col("text"), QUERY).alias("snippet"))


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return vectors, vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))


def vector_search(spark, sf_dir):
    vectors, query = _vectors(spark, sf_dir)
    return retrieval.vector_search(vectors, "embedding", query, 5, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_index_search(spark, sf_dir):
    """What each vector whose id is divisible by 50 finds among all, from an index that leaves out cells by the triangle inequality."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = VectorIndex.build(vectors, "embedding").search(queries, "query_id", "query", 5, "vec_id")
    return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


def vector_scores(spark, sf_dir):
    """The similarity of every vector to the query vector."""
    vectors, query = _vectors(spark, sf_dir)
    rows = query.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one query vector is asked for")
    return vectors.withColumn("query", F.lit(rows[0]["query"])).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("query")), 6).alias("score"))


def hybrid_search(spark, sf_dir):
    words = bm25_search(spark, sf_dir).select(F.concat(F.lit("doc "), "doc_id").alias("hit"), F.col("saturated").alias("score"))
    vectors = vector_search(spark, sf_dir).select(F.concat(F.lit("vec "), "vec_id").alias("hit"), "score")
    return retrieval.hybrid(vectors, words, 10, "hit")


def fts_search(spark, sf_dir):
    """Documents with any word of a query, by id, 20 at most."""
    return retrieval.full_text(_files(spark, sf_dir), "text", texts.search_words("tionble AND hereing* OR oueau")).select("doc_id").orderBy("doc_id").limit(20)


def fts_matches(spark, sf_dir):
    """How many documents of each language have any word of a query."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return retrieval.full_text(docs, "text", texts.search_words("tionble AND hereing* OR oueau OR nicht")).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    normalize_names, default_name_filter, hex_addresses, extract_calls, classify_strings, activity_profile_risk, catalog_profile_risk, complexity, category_keywords, truncations,
    chunk_documents, chunk_stats, bm25_search, bm25_scores, term_postings, keyword_index_search, keyword_index_upkeep, keyword_index_terms, snippets, vector_search, vector_index_search, vector_scores, hybrid_search, fts_search, fts_matches,
)}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _api(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '^__imp_', ''), '^_+(.)', '\1'), '^(.+)@[0-9]+$', '\1')"


NAMES = "names as (select distinct name from (select c_name as name from customer union all select s_name from supplier union all select p_name from part) union all select unnest([" + ", ".join(f"'{s}'" for s in SAMPLES) + "]))"
DLL = r"case when strpos(name, '::') > 1 then substr(name, strpos(name, '::') + 2) else name end"
SPACE = r"[\x20\x09-\x0D]+"
KIND = r"""case when length({v}) < 3 then null when regexp_matches(trim({v}), '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') then case when list_max(list_transform(string_split(trim({v}), '.'), lambda o: o::int)) <= 255 then 'ip' end
  when regexp_matches(trim({v}), '^(?i:https?)://[\w.-]+(?:/[\w./?%&=-]*)?$') then 'url'
  when regexp_matches(trim({v}), '^(HKEY_|HK[A-Z]{{2}})[\\A-Za-z0-9_-]+$') then 'registry'
  when regexp_matches(trim({v}), '^/[a-zA-Z0-9/_.-]+$') or regexp_matches(trim({v}), '^[A-Za-z]:\\[^<>:"|?*]+$') then 'path'
  when regexp_matches(trim({v}), '^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{{2,}}$')
    then case when not (regexp_matches(lower(trim({v})), '\.(dll|exe|sys|lib|obj|pdb|h|c|cpp)$|^version\.rc$') or (contains(lower(trim({v})), 'microsoft.com') and contains(lower(trim({v})), 'schema'))) then 'domain' end end"""
KEYS = _in(features.KEYWORDS)
CALLED = rf"coalesce(list_sort(list_filter(list_distinct(regexp_extract_all({{c}}, '\b([A-Za-z_@][A-Za-z0-9_@!:.]*)\s*\(', 1)), lambda n: lower(n) not in {KEYS})), [])"


def _category(calls: str, wanted) -> str:
    return f"list_distinct(list_transform(list_filter({calls}, lambda n: n in {_in(wanted)} or {_api('n')} in {_in(wanted)}), lambda n: {_api('n')}))"


def _trait_pattern(trait: str) -> str:
    """A trait's names as one pattern for names in a row, each between two blanks."""
    whole, parts, starts = features.TRAITS[trait]
    return "|".join([*(f" {n} " for n in whole), *parts, *(f" {n}" for n in starts)])


def _profiled(rows: str, kept: str) -> str:
    """Profile, score, level and flags over rows with calls and lists of strings by kind."""
    has = lambda c: f"len({c}) > 0"
    t = lambda c, k: f"regexp_matches(lower(' ' || array_to_string({c}, '  ') || ' '), '{_trait_pattern(k)}')"
    risks = "list_filter([" + ", ".join(f"case when len({_category('calls', w)}) > 0 then '{r}' end" for r, w in sorted(DANGEROUS.items())) + "], lambda x: x is not null)"
    sets = ", ".join(f"{_category('calls', w)} as {k}_" for k, w in CATEGORIES.items())
    labels = [
        f"case when {t('network_', 'server')} then 'NETWORK_SERVER' end",
        f"case when {t('network_', 'connects')} or {t('network_', 'http')} then 'NETWORK_CLIENT' end",
        f"case when ({t('network_', 'sends')} or {t('network_', 'receives')}) and not {t('network_', 'server')} and not {t('network_', 'connects')} and not {t('network_', 'http')} then 'NETWORK_IO' end",
        f"case when {t('network_', 'resolves')} then 'DNS_RESOLVER' end",
        f"case when {t('file_', 'reads')} and {t('file_', 'writes')} then 'FILE_RW' when {t('file_', 'writes')} then 'FILE_WRITER' when {t('file_', 'reads')} then 'FILE_READER' end",
        f"case when {t('file_', 'deletes')} then 'FILE_DELETER' end",
        f"case when {has('crypto_')} then case when {t('crypto_', 'encrypts')} and {t('crypto_', 'decrypts')} then 'CRYPTO_CIPHER' when {t('crypto_', 'encrypts')} then 'CRYPTO_ENCRYPT' when {t('crypto_', 'decrypts')} then 'CRYPTO_DECRYPT' when {t('crypto_', 'hashes')} then 'CRYPTO_HASH' else 'CRYPTO_USER' end end",
        f"case when {has('process_')} then case when {t('process_', 'injects')} then 'PROCESS_INJECTOR' else 'PROCESS_SPAWNER' end end",
        f"case when {has('network_')} and {has('file_')} then 'MIXED_IO' end",
    ]
    system = r"len(list_filter(paths, lambda p: regexp_matches(p, '^(/etc|/root|/var)|(?i:\\windows|\\system32|\\programdata)'))) > 0"
    points = [("network_", 2), ("ips", 3), ("urls", 2), ("domains", 1), ("file_", 1), ("crypto_", 1), ("process_", 2), ("registry", 2), ("risks", 3)]
    score = " + ".join(f"({has(c)})::int * {n}" for c, n in points) + f" + ({system})::int * 3 + (list_contains(risks, 'BUFFER_OVERFLOW_RISK') or list_contains(risks, 'COMMAND_INJECTION_RISK'))::int * 2 + ({has('network_')} and {has('file_')})::int * 2 + ({has('network_')} and {has('crypto_')})::int * 2"
    flag = lambda test, name: f"case when {test} then '{name}' end"
    says = lambda *w: f"regexp_matches(profile, '{'|'.join(w)}')"
    n, f, c, p, r = (has(x) for x in ("network_", "file_", "crypto_", "process_", "risks"))
    first = [flag(n, "NETWORK_CAPABLE"), flag(f"{n} and {says('NETWORK_SERVER')}", "ACCEPTS_CONNECTIONS"), flag(f"{n} and {says('NETWORK_CLIENT')}", "INITIATES_CONNECTIONS"), flag(f"{n} and {says('DNS_RESOLVER')}", "PERFORMS_DNS_LOOKUP"), flag(f, "FILE_IO_CAPABLE"), flag(f"{f} and {says('FILE_WRITER', 'FILE_RW')}", "WRITES_FILES"), flag(f"{f} and {says('FILE_READER', 'FILE_RW')}", "READS_FILES"), flag(f"{f} and {says('FILE_DELETER')}", "DELETES_FILES"), flag(c, "USES_CRYPTO"), flag(f"{c} and {says('CRYPTO_ENCRYPT')}", "ENCRYPTS_DATA"), flag(f"{c} and {says('CRYPTO_DECRYPT')}", "DECRYPTS_DATA"), flag(p, "SPAWNS_PROCESSES"), flag(f"{p} and {says('PROCESS_INJECTOR')}", "PROCESS_INJECTION_CAPABLE"), flag(r, "CALLS_DANGEROUS_FUNCTIONS")]
    last = [flag(has("ips"), "CONTAINS_HARDCODED_IPS"), flag(has("urls"), "CONTAINS_URLS"), flag(has("domains"), "CONTAINS_DOMAINS"), flag(has("registry"), "ACCESSES_REGISTRY"), flag(system, "ACCESSES_SYSTEM_PATHS"), flag(f"{n} and {f}", "POTENTIAL_DATA_EXFILTRATION"), flag(f"{n} and {c}", "ENCRYPTED_NETWORK_COMMS"), flag(f"{n} and {r}", "NETWORK_WITH_VULN_RISK"), "case level when 'HIGH' then 'HIGH_RISK' when 'MEDIUM' then 'MEDIUM_RISK' end"]
    full = lambda items: "list_filter([" + ", ".join(items) + "], lambda x: x is not null)"
    return f"""a as ({rows}), b as (select *, {sets}, {risks} as risks from a),
c as (select *, case when len(l) = 0 then 'NONE' else array_to_string(l, ', ') end as profile, ({score})::int as score from (select *, {full(labels)} as l from b)),
d as (select *, case when score >= 6 then 'HIGH' when score >= 3 then 'MEDIUM' else 'LOW' end as level from c)
select {kept}, profile, score, level, coalesce(array_to_string(list_concat(list_concat({full(first)}, risks), {full(last)}), ','), '') as flags from d"""


def _kinds(words: str) -> str:
    return ", ".join(f"list_filter({words}, lambda w: coalesce({KIND.format(v='w')} = '{k}', false)) as {c}" for c, k in (("ips", "ip"), ("urls", "url"), ("domains", "domain"), ("paths", "path"), ("registry", "registry")))


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
TERMS = QUERY.split()
BM25 = f"""w as (select doc_id, {TOKENS} as words from documents), c as (select doc_id, len(words) as n, {", ".join(f"len(list_filter(words, lambda x: x = '{t}')) as t{k}" for k, t in enumerate(TERMS))} from w),
s as (select count(*)::double as docs, avg(n) as mean, {", ".join(f"count(*) filter (t{k} > 0) as d{k}" for k in range(len(TERMS)))} from c),
bm as (select doc_id, {" + ".join(f"case when t{k} > 0 then 2.0::double * ln(1 + (docs - d{k} + 0.5::double) / (d{k} + 0.5::double)) * t{k} / (t{k} + 1.2::double * (0.25::double + 0.75::double * n / mean)) else 0 end" for k in range(len(TERMS)))} as score from c, s)"""
CHANGED = """changed as (select doc_id, case when lang = 'de' then text || ' haer' else text end as text from documents where doc_id not in (select doc_id from labels where toxic = 1)
union all select -1 - item_id, text from benchmark)"""
TOP_BM25 = "select doc_id, round(score, 6) as score, round(score / (score + 1), 6) as saturated from bm where score > 0 order by 2 desc, 1 limit 15"
VECTORS = "v as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q)"
TOP_VECTORS = "select vec_id, label, round(score, 6) as score from (select *, max(score) over () as best from (select * from v where score >= 0.5 order by score desc, vec_id limit 5)) where score >= 0.95 * best"
CHUNKS = r"""with recursive c as (
  select doc_id, text, 0 as chunk_id, 1 as a, case when length(text) > 500 and strpos(substr(text, 501), chr(10)) > 0 then 500 + strpos(substr(text, 501), chr(10)) else length(text) end as b from documents where length(text) > 0
  union all
  select doc_id, text, chunk_id + 1, b + 1, case when length(text) > b + 500 and strpos(substr(text, b + 501), chr(10)) > 0 then b + 500 + strpos(substr(text, b + 501), chr(10)) else length(text) end from c where b < length(text)
)"""


def _fts(*words: str) -> str:
    return f"list_has_any({TOKENS}, [{_in(words)[1:-1]}])"


ORACLE_SQL = {
    "normalize_names": rf"""with {NAMES} select name, {_api("name")} as api,
  regexp_replace(regexp_replace(regexp_replace(name, '^__imp_', ''), '^_{{1,2}}(.)', '\1'), '^(.+)@[0-9]+$', '\1') as external_,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^__imp_', ''), '^thunk_', ''), '^_{{1,2}}(.)', '\1'), '^(.+)@[0-9]+$', '\1') as thunk,
  {_api(f"regexp_replace(case when (contains({DLL}, '.DLL_') or contains({DLL}, '.dll_')) and strpos(lower({DLL}), '.dll_') > 1 then substr({DLL}, strpos(lower({DLL}), '.dll_') + 5) else {DLL} end, '^<EXTERNAL>::', '')")} as library from names""",
    "default_name_filter": f"""with {NAMES} select name, regexp_matches(case when name like '%::' then name else list_last(string_split(name, '::')) end, '{names.DEFAULT_PATTERN}') as is_default,
  regexp_matches(lower(name), 'socket|connect|send|recv|http|download|upload|network|client|server') as network, regexp_matches(lower(name), 'file|read|write|open|save|load|config|log') as file from names""",
    "hex_addresses": "select o_orderkey, '0x' || lower(to_hex(o_orderkey)) as address, o_orderkey as back from orders",
    "extract_calls": f"select page_id, array_to_string({CALLED.format(c='html')}, ',') as calls from pages",
    "classify_strings": f"""with v as (select value, count(*) as n from (select unnest(regexp_split_to_array(text, '{SPACE}')) as value from documents union all select url from pages) group by 1)
select value, n, {KIND.format(v="value")} as kind from v where kind is not null""",
    "activity_profile_risk": "with " + _profiled(f"select id, {CALLED.format(c='code')} as calls, {_kinds('words')} from (select *, regexp_split_to_array(code, '{SPACE}') as words from (select 'd' || doc_id as id, text as code from documents union all select 'p' || page_id, url || chr(10) || html from pages))", "id"),
    "catalog_profile_risk": "with n as (select p_partkey, names[p_partkey % len(names) + 1] as a, names[(p_partkey + p_size) % len(names) + 1] as b from part, (select [" + ", ".join(f"'{x}'" for x in CALLS) + "] as names)), " + _profiled("select p_partkey, list_sort([a, b]) as calls, []::varchar[] as ips, []::varchar[] as urls, []::varchar[] as domains, []::varchar[] as paths, []::varchar[] as registry from n", "p_partkey, array_to_string(risks, ',') as risks"),
    "complexity": r"""with c as (select page_id, len(string_split(regexp_replace(html, '\n+$', ''), chr(10))) as n_lines,
  len(regexp_extract_all(html, '\bif\s*\(')) + len(regexp_extract_all(html, '\bswitch\s*\(')) + len(regexp_extract_all(html, '\bcase\s+')) + len(regexp_extract_all(html, '\?.*:')) as n_branches,
  len(regexp_extract_all(html, '\bwhile\s*\(')) + len(regexp_extract_all(html, '\bfor\s*\(')) + len(regexp_extract_all(html, '\bdo\s*\{')) as n_loops,
  len(regexp_extract_all(html, '\b[a-zA-Z_][a-zA-Z0-9_]*\s*\(')) as n from pages),
d as (select page_id, n_lines::int as n_lines, n_branches::int as n_branches, n_loops::int as n_loops, greatest(0, n - n_branches - n_loops)::int as n_calls from c),
e as (select *, case when n_lines > 50 then 2 when n_lines > 20 then 1 else 0 end + case when n_branches > 10 then 2 when n_branches > 5 then 1 else 0 end + case when n_calls > 8 then 2 when n_calls > 4 then 1 else 0 end + case when n_loops > 3 then 2 when n_loops > 1 then 1 else 0 end as s from d)
select page_id, n_lines, n_branches, n_loops, n_calls, case when s >= 6 then 'very_complex' when s >= 4 then 'complex' when s >= 2 then 'moderate' else 'simple' end as level from e""",
    "category_keywords": f"""select doc_id, case {" ".join(f"when regexp_matches(lower(text), '{p}') then '{c}'" for c, p in texts.SUMMARY_CATEGORIES)} else 'utility' end as category,
  coalesce(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda w: length(w) > 3 and w not in {_in(texts.STOP_WORDS)})[:5], ' '), '') as keywords,
  case when length(text) > 60 then substr(text, 1, 60) || '...' else text end as short from documents""",
    "truncations": r"""with t as (select doc_id, text, length(text) // 4 as tokens from documents), k as (select *, floor(length(text) * (200.0::double / nullif(tokens, 0)))::bigint as keep from t)
select doc_id, md5(case when tokens > 200 then substr(text, 1, floor(keep * 0.7::double)::int) || chr(10) || chr(10) || '[... truncated for context management ...]' || chr(10) || chr(10) || right(text, floor(keep * 0.3::double)::int) else text end) as middle,
  md5(case when length(text) > 800 then regexp_replace(substr(text, 1, 800), '\n[^\n]*\z', '') || chr(10) || '// ... [truncated]' else text end) as at_line from k""",
    "chunk_documents": CHUNKS + " select doc_id, chunk_id, (b - a + 1)::int as n_chars, md5(substr(text, a, b - a + 1)) as digest from c",
    "chunk_stats": CHUNKS + " select doc_id, count(*) as n_chunks, max(b - a + 1)::int as longest, sum(b - a + 1)::bigint as n_chars from c group by 1",
    "bm25_search": f"with {BM25} {TOP_BM25}",
    "bm25_scores": f"with {BM25} select doc_id, round(score, 6) as score from bm where score > 0",
    "keyword_index_search": f"with {BM25} {TOP_BM25}",
    "keyword_index_upkeep": f"with {CHANGED}, {BM25.replace('documents', 'changed')} {TOP_BM25}",
    "keyword_index_terms": f"with {CHANGED} select term, count(*) as df from (select distinct doc_id, unnest({TOKENS}) as term from changed) group by 1",
    "term_postings": f"select term, count(*) as df, sum(tf)::bigint as cf from (select term, doc_id, count(*) as tf from (select doc_id, unnest({TOKENS}) as term from documents) group by 1, 2) group by 1",
    "snippets": f"""with p as (select doc_id, text, coalesce(least({", ".join(f"nullif(strpos(lower(text), '{t}'), 0)" for t in TERMS)}) - 1, length(text)) as best from documents),
q as (select *, greatest(0, best - 250) as a from p), r as (select *, least(length(text), a + 500) as b from q)
select doc_id, case when a > 0 then '...' else '' end || substr(text, a + 1, b - a) || case when b < length(text) then '...' else '' end as snippet from r""",
    "vector_index_search": """with v as (select q.vec_id as query_id, e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place, max(score) over (partition by query_id) as best from v where score >= 0.5)
select query_id, vec_id, label, round(score, 6) as score from r where place <= 5 and score >= 0.95 * best""",
    "vector_search": f"with {VECTORS} {TOP_VECTORS}",
    "vector_scores": f"with {VECTORS} select vec_id, round(score, 6) as score from v",
    "hybrid_search": f"with {BM25}, {VECTORS} select * from (select 'doc ' || doc_id as hit, saturated as score from ({TOP_BM25}) union all select 'vec ' || vec_id, score from ({TOP_VECTORS})) order by score desc, hit limit 10",
    "fts_search": f"select doc_id from documents where {_fts('tionble', 'hereing', 'oueau')} order by 1 limit 20",
    "fts_matches": f"select lang, count(*) as n from documents where {_fts('tionble', 'hereing', 'oueau', 'nicht')} group by 1",
}
