"""Crawl stage: raw page records -> article rows.

Order of work follows the original's cost order: the cheap URL predicates run first, the
HTML expressions only on rows that survive them.  Everything is one Catalyst plan; the only
exchange is the allowlist join, which AQE turns into a broadcast once the allowlist's actual
size is known (it is bounded by the number of registered domains, not by the crawl).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed, html as H, text as T, url as U

ARTICLE_COLUMNS = ["title", "text", "summary", "authors", "publish_date", "status", "url", "domain", "warc_date"]


def record_filter(df: DataFrame, rec_type: str = "rec_type", content_type: str = "content_type") -> DataFrame:
    """keep HTTP responses only (skipped when the columns are absent, as in page tables)."""
    if rec_type in df.columns and content_type in df.columns:
        return df.filter((F.col(rec_type) == "response")
                         & (F.col(content_type) == "application/http; msgtype=response"))
    return df


def url_columns(df: DataFrame, url: str = "url", suffixes=None) -> DataFrame:
    """P1 + P2 + helpers: clean_url, host, subdomain, domain, suffix, extension."""
    dom, sub, suf = U.split_domain(U.host(url), suffixes)
    return df.withColumns({
        "clean_url": U.canonical(url),
        "host": U.host(url),
        "subdomain": sub,
        "domain": dom,
        "suffix": suf,
        "extension": U.extension(url),
    })


def url_reject_reason(url: str = "url", max_len: int = fixed.MAX_URL_LENGTH,
                      banned_ext=None, banned_strings=None, allowed: Column | None = None) -> Column:
    """F2-F6 as one reason code; null = URL is acceptable.  ``allowed`` is the J1 outcome."""
    banned_ext = sorted(set(fixed.BANNED_EXTENSIONS if banned_ext is None else banned_ext))
    u = F.col(url)
    reason = (F.when(F.length(u) > max_len, "url_length"))
    if allowed is not None:
        reason = reason.when(~allowed, "domain")
    return (reason.when(F.col("extension").isin(banned_ext), "extension")
            .when(U.ending_count(url) > 1, "endings")
            .when(U.has_banned_string(url, banned_strings), "banned_string"))


def url_filter(df: DataFrame, allow: DataFrame, url: str = "url", suffixes=None,
               max_len: int = fixed.MAX_URL_LENGTH, banned_ext=None, banned_strings=None,
               keep_rejects: bool = False) -> DataFrame:
    """F2-F6 + J1.  ``allow(domain, subdomains)``: null subdomains = any subdomain.

    Returns the input plus clean_url/domain/subdomain (and ``url_reject`` when ``keep_rejects``).
    Without rejects the cheap URL predicates run first and the allowlist test is a left-semi join
    on the survivors (no row duplication, and a sort-merge fallback would move only survivors).
    """
    df = url_columns(df, url, suffixes)
    a = allow.select(F.col("domain").alias("_allow_domain"), F.col("subdomains").alias("_allow_subs"))
    cond = ((F.col("domain") == F.col("_allow_domain"))
            & (F.col("_allow_subs").isNull() | F.array_contains(F.col("_allow_subs"), F.col("subdomain"))))
    if not keep_rejects:
        cheap = url_reject_reason(url, max_len, banned_ext, banned_strings, allowed=None)
        return df.where(cheap.isNull()).join(a, cond, "left_semi")
    # Left join keeps every record; the array test is the residual condition of the equi-join.
    joined = df.join(a, cond, "left")
    allowed = F.col("_allow_domain").isNotNull()
    out = joined.withColumn("url_reject", url_reject_reason(url, max_len, banned_ext, banned_strings, allowed))
    return out.drop("_allow_domain", "_allow_subs")


def extract_articles(df: DataFrame, html: str = "html") -> DataFrame:
    """P26 + P3 + P4 + P5 + P6 + F16: HTML -> title, text, lang, authors, publish_date, summary."""
    h = F.col(html)
    fields = F.struct(H.title(h).alias("title"), H.lang(h).alias("lang"), H.body_text(h).alias("_raw_text"),
                      H.authors(h).alias("authors"), H.publish_date(h).alias("publish_date"),
                      H.summary(h).alias("summary"))
    # The fields leave through a one-element ``inline`` (a Generate node).  Predicates on them
    # (quality gates) cannot be pushed beneath it, so the regex chain runs once per record instead
    # of once in the pushed-down filter and again in the projection.
    drop = [c for c in ("title", "lang", "authors", "publish_date", "summary", "text") if c in df.columns]
    out = df.drop(*drop).select("*", F.inline(F.array(fields)))
    return out.withColumn("text", T.cut_leading_title("_raw_text", "title")).drop("_raw_text")


def quality_reason(require_date: bool = True, min_text: int = fixed.MIN_TEXT_LENGTH,
                   min_title: int = fixed.MIN_TITLE_LENGTH, lang: str = fixed.REQUIRED_LANGUAGE,
                   html: str | None = "html") -> Column:
    """F7-F12 in the original's order: parse, date, len, title, lang (null = accepted)."""
    r = F.when(F.lit(False), F.lit(None).cast("string"))
    if html is not None:
        r = r.when(F.col(html).isNull() | (F.length(F.col(html)) == 0), "parse")
    if require_date:
        r = r.when(F.col("publish_date").isNull(), "date")
    return (r.when(F.length("text") < min_text, "len")
            .when(F.length("title") < min_title, "title")
            .when(F.coalesce(F.col("lang"), F.lit("")) != lang, "lang"))


def quality_filter(df: DataFrame, require_date: bool = True, min_text: int = fixed.MIN_TEXT_LENGTH,
                   min_title: int = fixed.MIN_TITLE_LENGTH, lang: str = fixed.REQUIRED_LANGUAGE,
                   keep_rejects: bool = False, html: str | None = "html") -> DataFrame:
    out = df.withColumn("reject_reason", quality_reason(require_date, min_text, min_title, lang, html))
    if keep_rejects:
        return out
    return out.filter(F.col("reject_reason").isNull()).drop("reject_reason", "lang")


def with_lineage(df: DataFrame, warc_date: Column | None = None) -> DataFrame:
    """status/url/domain/warc_date; ``url`` becomes the canonical URL."""
    return df.withColumns({
        "status": F.lit("success"),
        "url": F.col("clean_url"),
        "warc_date": warc_date if warc_date is not None else F.lit(None).cast("string"),
    })


def num_empty(df: DataFrame, cols: list[str], name: str = "num_empty") -> DataFrame:
    """Number of falsy fields (null, '' or empty array)."""
    types = dict(df.dtypes)
    terms = []
    for c in cols:
        t = types[c]
        if t.startswith("array"):
            terms.append(F.when(F.col(c).isNull() | (F.size(c) == 0), 1).otherwise(0))
        elif t == "string":
            terms.append(F.when(F.col(c).isNull() | (F.col(c) == ""), 1).otherwise(0))
        else:
            terms.append(F.when(F.col(c).isNull() | (F.col(c) == 0), 1).otherwise(0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(name, total)


def crawl(pages: DataFrame, allow: DataFrame, suffixes=None, require_date: bool = True,
          keep_rejects: bool = False, url: str = "url", html: str = "html",
          warc_date: str | None = None) -> DataFrame:
    """The whole crawl stage: records -> articles (F22 reason codes when ``keep_rejects``).

    Without rejects, URL rules and the allowlist run before any HTML expression (the extraction
    only sees surviving records); with rejects every record is extracted to report its reason.
    """
    df = record_filter(pages)
    wd = F.col(warc_date).cast("string") if warc_date else None
    if not keep_rejects:
        df = url_filter(df, allow, url=url, suffixes=suffixes)
        df = extract_articles(df, html)
        df = quality_filter(df, require_date=require_date, html=html)
        return with_lineage(df, wd)
    df = url_filter(df, allow, url=url, suffixes=suffixes, keep_rejects=True)
    df = extract_articles(df, html)
    qual = quality_reason(require_date=require_date, html=html)
    df = df.withColumn("reject_reason", F.coalesce(F.col("url_reject"), qual)).drop("url_reject")
    return with_lineage(df, wd)


def reject_report(rejects: DataFrame) -> DataFrame:
    """F22 report: rows per reason ('accepted' for kept rows)."""
    return (rejects.groupBy(F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))
