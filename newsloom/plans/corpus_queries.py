"""Registered queries of the crawl and merge stages, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, text as T
from newsloom.operators import crawl as C, dedupe as D, merge as M
from newsloom.plans import common as K, sqltext as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


PARTS = K.url_parts_sql("pages")
ALLOW = K.allow_sql(PARTS)
REJ = K.url_reject_sql(PARTS, ALLOW)


# ------------------------------------------------------------------------------ crawl stage
@register("crawl_url_parts", f"""
SELECT page_id, clean_url, host, subdomain, domain, extension FROM {PARTS}""")
def crawl_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """P1 + P2: canonical URL, host, registered domain and subdomain, path extension."""
    pages = K.table(spark, sf, "pages")
    return C.url_columns(pages, suffixes=K.QUERY_SUFFIXES).select(
        "page_id", "clean_url", "host", "subdomain", "domain", "extension")


@register("crawl_url_filter", f"""
SELECT page_id, domain, subdomain, url_reject FROM {REJ}""")
def crawl_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F2-F6 + J1: every page with its URL verdict (null = accepted)."""
    pages = K.table(spark, sf, "pages")
    allow = K.page_allowlist(pages)
    return C.url_filter(pages, allow, suffixes=K.QUERY_SUFFIXES, keep_rejects=True).select(
        "page_id", "domain", "subdomain", "url_reject")


EXTRACT_SQL = f"""(SELECT *, {S.cut_leading_title('raw_text', 'title')} AS text FROM (
  SELECT *, {S.html_title('html')} AS title, {S.html_lang('html')} AS lang, {S.html_body('html')} AS raw_text
  FROM pages))"""


@register("crawl_extract", f"""
SELECT page_id, lang, title, text, length(text) AS n_chars FROM {EXTRACT_SQL}""")
def crawl_extract(spark: SparkSession, sf: str) -> DataFrame:
    """P26 + P3 + P4: HTML -> language, title, body text."""
    pages = K.table(spark, sf, "pages")
    return C.extract_articles(pages).select("page_id", "lang", "title", "text",
                                            F.length("text").alias("n_chars"))


def _crawl_rejects(spark: SparkSession, sf: str) -> DataFrame:
    pages = K.table(spark, sf, "pages")
    return C.crawl(pages, K.page_allowlist(pages), suffixes=K.QUERY_SUFFIXES, require_date=False,
                   keep_rejects=True)


CRAWL_SQL = f"""(SELECT r.*, {S.cut_leading_title('r.raw_text', 'r.title')} AS text FROM (
  SELECT *, {S.html_title('html')} AS title, {S.html_lang('html')} AS lang, {S.html_body('html')} AS raw_text
  FROM {REJ}) r)"""
CRAWL_REASON_SQL = f"""(SELECT *, coalesce(url_reject, CASE
    WHEN html IS NULL OR length(html) = 0 THEN 'parse'
    WHEN length(text) < {fixed.MIN_TEXT_LENGTH} THEN 'len'
    WHEN length(title) < {fixed.MIN_TITLE_LENGTH} THEN 'title'
    WHEN coalesce(lang, '') <> '{fixed.REQUIRED_LANGUAGE}' THEN 'lang' END) AS reject_reason
  FROM {CRAWL_SQL})"""


@register("crawl_reject_report", f"""
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM {CRAWL_REASON_SQL} GROUP BY 1""")
def crawl_reject_report(spark: SparkSession, sf: str) -> DataFrame:
    """the whole crawl cascade with a reason code per rejected record."""
    return C.reject_report(_crawl_rejects(spark, sf))


@register("crawl_articles", f"""
SELECT page_id, clean_url AS url, domain, title, text, 'success' AS status
FROM {CRAWL_REASON_SQL} WHERE reject_reason IS NULL""")
def crawl_articles(spark: SparkSession, sf: str) -> DataFrame:
    """S1 -> F1-F12 -> P8: accepted articles with lineage columns (date not required: the
    test pages carry none)."""
    pages = K.table(spark, sf, "pages")
    arts = C.crawl(pages, K.page_allowlist(pages), suffixes=K.QUERY_SUFFIXES, require_date=False)
    return arts.select("page_id", "url", "domain", "title", "text", "status")


@register("crawl_empty_fields", f"""
SELECT page_id, (CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END)
  + (CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END)
  + (CASE WHEN lang IS NULL OR lang = '' THEN 1 ELSE 0 END) AS num_empty
FROM {EXTRACT_SQL}""")
def crawl_empty_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Number of empty extracted fields per page."""
    arts = C.extract_articles(K.table(spark, sf, "pages"))
    return C.num_empty(arts, ["title", "text", "lang"]).select("page_id", "num_empty")


CRAWL_KEPT_SQL = K.greedy_sql(
    f"(SELECT page_id, clean_url AS url, domain, substr(text, 1, {fixed.CONTENT_LENGTH}) AS ckey "
    f"FROM {CRAWL_REASON_SQL} WHERE reject_reason IS NULL)", "page_id", "url", "ckey")


@register("crawl_domain_counts", f"""
SELECT domain, count(*) AS n_articles FROM {CRAWL_KEPT_SQL} GROUP BY domain""")
def crawl_domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: pages -> URL rules + allowlist -> extraction -> quality gates -> greedy
    (url, content-start: P27) dedupe in page order -> articles per domain (A1)."""
    pages = K.table(spark, sf, "pages")
    arts = C.crawl(pages, K.page_allowlist(pages), suffixes=K.QUERY_SUFFIXES, require_date=False)
    arts = arts.withColumn("ckey", T.content_key("text"))
    kept = D.greedy_dedupe(arts, ["url", "ckey"], "page_id")
    return M.domain_counts(kept)


# ------------------------------------------------------------------------------ merge stage
INJ = K.inject_sql("documents")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return K.inject(K.table(spark, sf, "documents"))


def _byline_sql(src: str) -> str:
    """P9 + F15 in DuckDB over rows with (text, authors)."""
    after = "substring(text, 4)"
    first = f"split_part({after}, chr(10), 1)"
    cond = (f"(len(authors) = 0 AND starts_with(text, 'By ') AND contains({after}, chr(10)) "
            f"AND len(string_split({first}, ' ')) < {fixed.BYLINE_MAX_WORDS})")
    rest = f"substring({after}, length({first}) + 2)"
    lowered = S.strip("lower(x)")
    prefixes = " OR ".join(f"starts_with({lowered}, {S.q(p)})" for p in fixed.AUTHOR_BAD_PREFIXES)
    words = ", ".join(S.q(w) for w in fixed.AUTHOR_BAD_WORDS)
    authors = f"(CASE WHEN {cond} THEN [{S.strip(first)}] ELSE authors END)"
    filt = (f"list_filter({authors}, lambda x: NOT ({prefixes}) AND NOT contains({lowered}, '.com') "
            f"AND NOT ({lowered} IN ({words})))")
    return f"""(SELECT * REPLACE ({filt} AS authors, (CASE WHEN {cond} THEN {S.strip(rest)} ELSE text END) AS text)
      FROM {src})"""


CLEAN_SQL = f"(SELECT * REPLACE ({S.boilerplate('text')} AS text) FROM {_byline_sql(INJ)})"


@register("doc_clean", f"""
SELECT doc_id, array_to_string(authors, '|') AS authors, text, length(text) AS n_chars FROM {CLEAN_SQL}""")
def doc_clean(spark: SparkSession, sf: str) -> DataFrame:
    """P9 byline recovery + F15 author rules + P11/P12 boilerplate removal on every document."""
    df = M.fix_authors(_docs(spark, sf), summary=None)
    df = M.strip_boilerplate(df, domain=None)
    return df.select("doc_id", F.array_join("authors", "|").alias("authors"), "text",
                     F.length("text").alias("n_chars"))


BAN_SQL = f"""(SELECT *, CASE WHEN len(regexp_extract_all(text, {S.q(fixed.GALLERY_PATTERN)})) > {fixed.MAX_GALLERY_MATCHES} THEN 'gallery'
    WHEN array_to_string(authors, ' ') = {S.q(fixed.BANNED_AUTHOR_LINE)} THEN 'author_line' END AS ban_reason FROM {CLEAN_SQL})"""


@register("doc_ban", f"""
SELECT doc_id, ban_reason FROM {BAN_SQL} WHERE ban_reason IS NOT NULL""")
def doc_ban(spark: SparkSession, sf: str) -> DataFrame:
    """F13 + F14: documents that are always rejected, with the rule that fired."""
    df = M.strip_boilerplate(M.fix_authors(_docs(spark, sf), summary=None), domain=None)
    return D.ban_rows(df, keep_rejects=True).where(F.col("ban_reason").isNotNull()).select("doc_id", "ban_reason")


DEDUPE_RAW_SQL = K.greedy_sql(
    f"(SELECT doc_id, right(text, {fixed.CONTENT_LENGTH}) AS k_end, substr(text, 1, {fixed.CONTENT_LENGTH}) AS k_start FROM documents)",
    "doc_id", "k_end", "k_start")


@register("doc_dedupe", f"SELECT doc_id FROM {DEDUPE_RAW_SQL}")
def doc_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + P27: greedy first-seen on (last 100, first 100 characters) in doc_id order."""
    docs = K.table(spark, sf, "documents").select(
        "doc_id", T.content_key("text", end=True).alias("k_end"), T.content_key("text").alias("k_start"))
    return D.greedy_dedupe(docs, ["k_end", "k_start"], "doc_id").select("doc_id")


CROWD_SQL = K.greedy_sql(
    "(SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS k1, c_mktsegment || ':' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS k2 FROM customer)",
    "c_custkey", "k1", "k2")


@register("dedupe_crowded", f"SELECT c_custkey, k1, k2 FROM {CROWD_SQL}")
def dedupe_crowded(spark: SparkSession, sf: str) -> DataFrame:
    """D1 with crowded keys (nation; segment + balance band): many rounds, and the case where
    chained single-key dedupes give a different answer."""
    cust = K.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("k1"),
        F.concat(F.col("c_mktsegment"), F.lit(":"), F.floor(F.col("c_acctbal") / 1000).cast("bigint").cast("string")).alias("k2"))
    return D.greedy_dedupe(cust, ["k1", "k2"], "c_custkey")


@register("doc_first_seen", f"""
SELECT doc_id FROM (SELECT doc_id, substr(text, 1, {fixed.CONTENT_LENGTH}) AS k,
  min(doc_id) OVER (PARTITION BY substr(text, 1, {fixed.CONTENT_LENGTH})) AS m FROM documents) WHERE doc_id = m""")
def doc_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """D3: earliest document of each 100-character prefix."""
    docs = K.table(spark, sf, "documents").withColumn("k", T.content_key("text"))
    return D.first_seen(docs, "k", "doc_id").select("doc_id")


MERGE_IN_SQL = f"""(SELECT b.*, o.priority, right(b.text, {fixed.CONTENT_LENGTH}) AS k_end, substr(b.text, 1, {fixed.CONTENT_LENGTH}) AS k_start
  FROM {BAN_SQL} b JOIN {K.source_priority_sql('documents')} o ON b.source = o.dump WHERE b.ban_reason IS NULL)"""
MERGE_SQL = K.greedy_sql(MERGE_IN_SQL, "priority, doc_id", "k_end", "k_start")
SPLIT_EXPR = f"CASE WHEN {S.uniform(0, 'split', 'doc_id')} < {fixed.TRAIN_PORTION} THEN 'train' ELSE 'val' END"


def _merged(spark: SparkSession, sf: str, seen=None, only=None) -> DataFrame:
    raw = K.table(spark, sf, "documents")
    docs = M.with_priority(K.inject(raw), K.source_priority(raw), dump="source")
    docs = M.fix_authors(docs, summary=None)
    docs = M.strip_boilerplate(docs, domain=None)
    docs = D.ban_rows(docs)
    docs = docs.withColumns({"k_end": T.content_key("text", end=True), "k_start": T.content_key("text"),
                             "_order": D.order_column("priority", "doc_id")})
    kept = D.greedy_dedupe(docs, ["k_end", "k_start"], "_order")
    return M.assign_split(kept.drop("_order"), "doc_id")


@register("doc_merge", f"SELECT doc_id, source, priority, {SPLIT_EXPR} AS split FROM {MERGE_SQL}")
def doc_merge(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + D4 + J7 + P9-P12 + F13/F14 + D1 + P14: the merged corpus, sources newest first."""
    return _merged(spark, sf).select("doc_id", "source", "priority", "split")


@register("doc_source_counts", f"""
SELECT source AS domain, {SPLIT_EXPR.replace('doc_id', 'doc_id')} AS split, count(*) AS n_articles
FROM {MERGE_SQL} GROUP BY ALL""")
def doc_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + A9: kept articles per domain (source) and split."""
    kept = _merged(spark, sf).withColumnRenamed("source", "domain")
    return kept.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("n_articles"))


@register("doc_hits_misses", f"""
SELECT (SELECT count(*) FROM {MERGE_SQL}) AS hits,
       (SELECT count(*) FROM documents) - (SELECT count(*) FROM {MERGE_SQL}) AS misses""")
def doc_hits_misses(spark: SparkSession, sf: str) -> DataFrame:
    """A2: hits and misses of the merge (no archive rows in the test corpus)."""
    docs = K.table(spark, sf, "documents")
    kept = _merged(spark, sf)
    return M.hit_miss(docs, kept, "doc_id")


@register("doc_split_share", f"""
SELECT {SPLIT_EXPR} AS split, count(*) AS n FROM documents GROUP BY 1""")
def doc_split_share(spark: SparkSession, sf: str) -> DataFrame:
    """Hash-Bernoulli 95/5 split of every document."""
    return M.assign_split(K.table(spark, sf, "documents"), "doc_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))


INC_OLD = 10


@register("doc_incremental", f"SELECT doc_id FROM {MERGE_SQL} WHERE priority > {INC_OLD}")
def doc_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The newest sources are merged first; the older ones arrive as a second batch and are
    deduplicated against the keys registered by the first (J4 anti-joins) and then among themselves."""
    raw = K.table(spark, sf, "documents")
    docs = M.with_priority(K.inject(raw), K.source_priority(raw), dump="source")
    docs = D.ban_rows(M.strip_boilerplate(M.fix_authors(docs, summary=None), domain=None))
    docs = docs.withColumns({"k_end": T.content_key("text", end=True), "k_start": T.content_key("text"),
                             "_order": D.order_column("priority", "doc_id")})
    first = D.greedy_dedupe(docs.where(F.col("priority") <= INC_OLD), ["k_end", "k_start"], "_order")
    second = D.greedy_dedupe(docs.where(F.col("priority") > INC_OLD), ["k_end", "k_start"], "_order",
                             seen=D.seen_keys(first, ["k_end", "k_start"]))
    return second.select("doc_id")


@register("doc_sample", f"""
SELECT doc_id, source FROM {MERGE_SQL} ORDER BY {S.uniform(0, 'sample', 'doc_id')}, doc_id LIMIT 50""")
def doc_sample(spark: SparkSession, sf: str) -> DataFrame:
    """W8 + A11: a seeded random sample of 50 merged articles (sampling is the feature)."""
    return M.sample_articles(_merged(spark, sf), 50, "doc_id").select("doc_id", "source")


PATH_SQL = """(SELECT doc_id, 'crawl-data/' || source || '/segments/' || CAST(doc_id // 100 AS VARCHAR) || '/warc/part-'
    || CAST(doc_id AS VARCHAR) || '.warc.gz' AS path FROM documents)"""


@register("doc_dump_keys", f"""
SELECT doc_id, string_split(path, '/')[2] AS dump,
  string_split(path, '/')[2] || '/' || array_to_string(string_split(path, '/')[3:], '_') || '.jsonl' AS out_key
FROM {PATH_SQL}""")
def doc_dump_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Dump id and output key from an archive path (paths built from each document's source)."""
    d = K.table(spark, sf, "documents")
    path = F.concat(F.lit("crawl-data/"), F.col("source"), F.lit("/segments/"),
                    F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/warc/part-"),
                    F.col("doc_id").cast("string"), F.lit(".warc.gz"))
    dump, key = M.dump_and_key("path")
    return d.select("doc_id", path.alias("path")).select("doc_id", dump.alias("dump"), key.alias("out_key"))


@register("doc_bloom_seen", f"""
WITH kept AS (SELECT doc_id, k_start FROM {MERGE_SQL} WHERE priority <= {INC_OLD})
SELECT doc_id, EXISTS (SELECT 1 FROM kept WHERE k_start = substr(text, 1, {fixed.CONTENT_LENGTH})) AS maybe_seen,
       doc_id IN (SELECT doc_id FROM kept) AS in_filter
FROM documents""")
def doc_bloom_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's content key looked up among the keys kept from the newest sources, by an exact join;
    kept documents must all be seen."""
    raw = K.table(spark, sf, "documents")
    docs = M.with_priority(K.inject(raw), K.source_priority(raw), dump="source")
    docs = D.ban_rows(M.strip_boilerplate(M.fix_authors(docs, summary=None), domain=None))
    docs = docs.withColumns({"k_end": T.content_key("text", end=True), "k_start": T.content_key("text"),
                             "_order": D.order_column("priority", "doc_id")})
    first = D.greedy_dedupe(docs.where(F.col("priority") <= INC_OLD), ["k_end", "k_start"], "_order")
    probe = raw.select("doc_id", T.content_key("text").alias("k"))
    seen = D.mark_seen(probe, "k", first, "k_start", "maybe_seen")
    kept_ids = first.select("doc_id").withColumn("in_filter", F.lit(True))
    return (seen.join(kept_ids, "doc_id", "left")
            .select("doc_id", "maybe_seen", F.coalesce(F.col("in_filter"), F.lit(False)).alias("in_filter")))
