"""Shared inputs of the registered queries: table loading, the page allowlist, fixture injection.

Everything here is derived from the given tables by Spark, so the work of every query grows
with them.  Each helper has a DuckDB twin used by the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.url import DEFAULT_SUFFIXES
from newsloom.operators import crawl as C
from newsloom.plans import sqltext as S

# Private suffix entries (like the hosting-provider section of a public suffix list): the test
# pages live under example.{com,net,org}, so registered domains become e.g. "tionsh.example.net".
QUERY_SUFFIXES = DEFAULT_SUFFIXES + ["example.com", "example.net", "example.org"]
NET_SUBDOMAINS = ["", "www", "blog"]


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a test table.  The text-heavy tables get at least one partition per core: a single
    small file with few row groups would otherwise leave cores idle.  On a cluster the input has
    far more splits than cores and this never applies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    return df


def page_allowlist(pages: DataFrame) -> DataFrame:
    """Allowlist derived from the crawl itself: every registered domain without a hyphen (the
    spam farms of the test crawl all carry one); on ``example.net`` only the bare, www and blog
    subdomains are allowed, elsewhere any subdomain (null)."""
    parts = C.url_columns(pages.select("url"), suffixes=QUERY_SUFFIXES)
    return (parts.where(F.col("domain").isNotNull() & ~F.contains(F.col("domain"), F.lit("-")))
            .select("domain", "suffix").distinct()
            .select("domain", F.when(F.col("suffix") == "example.net",
                                     F.array(*[F.lit(s) for s in NET_SUBDOMAINS]))
                    .otherwise(F.lit(None).cast("array<string>")).alias("subdomains")))


def url_parts_sql(src: str = "pages") -> str:
    """DuckDB: page rows + clean_url, host, subdomain, domain, suffix, extension."""
    depth = S.depth_case("labels", "n", QUERY_SUFFIXES)
    return f"""(SELECT *,
        CASE WHEN depth IS NOT NULL THEN labels[n - depth] || '.' || array_to_string(labels[n - depth + 1:n], '.') END AS domain,
        CASE WHEN depth IS NOT NULL THEN (CASE WHEN n - depth - 1 > 0 THEN array_to_string(labels[1:n - depth - 1], '.') ELSE '' END) END AS subdomain,
        CASE WHEN depth IS NOT NULL THEN array_to_string(labels[n - depth + 1:n], '.') END AS suffix
      FROM (SELECT *, {depth} AS depth FROM (
        SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM (
          SELECT *, {S.canonical('url')} AS clean_url, {S.host('url')} AS host, {S.extension('url')} AS extension
          FROM {src}))))"""


def allow_sql(parts: str) -> str:
    subs = "[" + ", ".join(S.q(s) for s in NET_SUBDOMAINS) + "]"
    return f"""(SELECT DISTINCT domain AS a_domain,
        CASE WHEN suffix = 'example.net' THEN {subs} ELSE NULL END AS a_subs
      FROM {parts} WHERE domain IS NOT NULL AND NOT contains(domain, '-'))"""


def url_reject_sql(parts: str, allow: str) -> str:
    """DuckDB twin of crawl.url_filter(keep_rejects=True)."""
    from newsloom.functions import fixed
    exts = ", ".join(S.q(e) for e in sorted(set(fixed.BANNED_EXTENSIONS)))
    return f"""(SELECT p.*, CASE
        WHEN length(p.url) > {fixed.MAX_URL_LENGTH} THEN 'url_length'
        WHEN a.a_domain IS NULL THEN 'domain'
        WHEN p.extension IN ({exts}) THEN 'extension'
        WHEN {S.ending_count('p.url')} > 1 THEN 'endings'
        WHEN regexp_matches(p.url, {S.q(S.banned_pattern())}) THEN 'banned_string'
      END AS url_reject
      FROM {parts} p LEFT JOIN {allow} a
        ON p.domain = a.a_domain AND (a.a_subs IS NULL OR list_contains(a.a_subs, p.subdomain)))"""


# ------------------------------------------------------------------------------------------
# Fixture phrases appended to documents (the test corpus has none of them).  The phrase for a
# document is chosen by its id, so every document is processed and ~1 in 10 carries each case.
INJECTED = [
    "\nADVERTISEMENT ADVERTISEMENT",
    "\nAdvertisement \t Advertisement",
    " (Photo: Jane Roe/Wire Agency)",
    "\nImage: Courtesy of the city archive",
    "\nPhoto Published on 03-04-2019 by staff",
    ". Photo: Staff photographer",
    "\nPicture Courtesy: Wire Agency",
    "\nREAD MORE: Other stories of the day",
    "\nShare this: Facebook\nTwitter\nGoogle\nWhatsApp\nEmail\nCopy",
    "",
]
GALLERY_PHRASE = " Image 1 of 3 Image 2 of 3 Image 3 of 3"
BYLINES = ["By Jane Roe\n", "By News Traffic Weather\n", "By www.example-news.com\n"]


def inject(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """documents + authors=[] + fixture phrases (text only; every row kept)."""
    i = F.col(id_col)
    phrase = F.element_at(F.array(*[F.lit(p) for p in INJECTED]), (F.pmod(i, F.lit(len(INJECTED))) + 1).cast("int"))
    gallery = F.when(F.pmod(i, F.lit(17)) == 3, F.lit(GALLERY_PHRASE)).otherwise(F.lit(""))
    byline = (F.when(F.pmod(i, F.lit(11)) == 0, F.lit(BYLINES[0]))
              .when(F.pmod(i, F.lit(13)) == 0, F.lit(BYLINES[1]))
              .when(F.pmod(i, F.lit(19)) == 0, F.lit(BYLINES[2])).otherwise(F.lit("")))
    return df.withColumns({
        "text": F.concat(byline, F.col("text"), gallery, phrase),
        "authors": F.array().cast("array<string>"),
    })


def inject_sql(src: str = "documents", id_col: str = "doc_id") -> str:
    def lit(s: str) -> str:
        if s == "":
            return "''"
        parts = s.split("\n")
        out = []
        for j, p in enumerate(parts):
            if j:
                out.append(S.NL)
            if p:
                out.append(S.q(p).replace("\t", "' || chr(9) || '"))
        return "(" + " || ".join(out) + ")"
    phrases = "[" + ", ".join(lit(p) for p in INJECTED) + "]"
    return f"""(SELECT * REPLACE (
        (CASE WHEN {id_col} % 11 = 0 THEN {lit(BYLINES[0])} WHEN {id_col} % 13 = 0 THEN {lit(BYLINES[1])}
              WHEN {id_col} % 19 = 0 THEN {lit(BYLINES[2])} ELSE '' END)
        || text || (CASE WHEN {id_col} % 17 = 3 THEN {S.q(GALLERY_PHRASE)} ELSE '' END)
        || {phrases}[{id_col} % {len(INJECTED)} + 1] AS text),
        []::VARCHAR[] AS authors
      FROM {src})"""


def source_priority(docs: DataFrame, source: str = "source") -> DataFrame:
    """D4 / J7 for the test corpus: ``source`` plays the dump; newest (highest number) first.

    The order table has one row per distinct source; the global window runs on that tiny table
    only, and the result is broadcast (its size is the number of dumps)."""
    srcs = docs.select(source).distinct()
    num = F.regexp_extract(F.col(source), r"(\d+)", 1).cast("int")
    return srcs.select(F.col(source).alias("dump"),
                       F.row_number().over(Window.orderBy(num.desc(), F.col(source))).alias("priority"))


def source_priority_sql(src: str = "documents") -> str:
    return f"""(SELECT source AS dump, row_number() OVER (ORDER BY CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) DESC, source) AS priority
      FROM (SELECT DISTINCT source FROM {src}))"""


def greedy_sql(src: str, order: str, k1: str, k2: str) -> str:
    """DuckDB reference of D1: a sequential walk in ``order`` carrying the registered key codes."""
    return f"""(WITH RECURSIVE g_src AS (SELECT *, row_number() OVER (ORDER BY {order}) AS g_rn FROM {src}),
      g_codes AS (SELECT g_rn, dense_rank() OVER (ORDER BY {k1}) AS c1, dense_rank() OVER (ORDER BY {k2}) AS c2 FROM g_src),
      g_walk(g_rn, keep, s1, s2) AS (
        SELECT 0::BIGINT, false, []::BIGINT[], []::BIGINT[]
        UNION ALL
        SELECT c.g_rn,
               NOT (list_contains(w.s1, c.c1) OR list_contains(w.s2, c.c2)),
               CASE WHEN NOT (list_contains(w.s1, c.c1) OR list_contains(w.s2, c.c2)) THEN list_append(w.s1, c.c1) ELSE w.s1 END,
               CASE WHEN NOT (list_contains(w.s1, c.c1) OR list_contains(w.s2, c.c2)) THEN list_append(w.s2, c.c2) ELSE w.s2 END
        FROM g_walk w JOIN g_codes c ON c.g_rn = w.g_rn + 1)
      SELECT g_src.* EXCLUDE (g_rn) FROM g_src JOIN g_walk USING (g_rn) WHERE keep)"""
