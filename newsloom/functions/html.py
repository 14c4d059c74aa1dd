"""Page HTML -> article fields, as regular-expression Catalyst expressions.

The original relies on a per-page Python extraction library; at corpus scale the same
contract (title, language, body text, authors, publish date, description metas) is met
with JVM regex expressions that codegen and need no Python worker:

* ``lang``   -- ``<html lang="..">`` (primary subtag, lower case), else ``content-language`` meta.
* ``title``  -- ``<title>`` text, entities decoded, stripped.
* ``text``   -- the ``<article>`` element (whole ``<body>`` when absent) with script, style and
  the ``<h1>`` headline removed, paragraph/line-break/list/div tags turned into newlines, other
  tags dropped, entities decoded, newline runs collapsed (P3), stripped.
* ``authors`` -- every ``<meta name="author" content>`` value with fewer than 10 words (F16).
* ``publish_date`` -- first date-like meta (``article:published_time``, ``date``, ``pubdate``)
  rendered ``MM-dd-yyyy`` (P5); null when absent or not a date.
* description metas -> ``summary`` (P6).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def meta_content(html, name: str) -> Column:
    """Value of ``<meta name|property="name" content="...">`` ('' when absent)."""
    pat = (r'(?is)<meta[^>]*?(?:name|property)\s*=\s*"' + name.replace(".", r"\.")
           + r'"[^>]*?content\s*=\s*"([^"]*)"')
    return T.unescape_html(F.regexp_extract(_c(html), pat, 1))


def lang(html) -> Column:
    h = _c(html)
    from_tag = F.regexp_extract(h, r'(?is)<html[^>]*?\slang\s*=\s*"([A-Za-z]+)', 1)
    from_meta = F.regexp_extract(h, r'(?is)<meta[^>]*?http-equiv\s*=\s*"content-language"[^>]*?content\s*=\s*"([A-Za-z]+)', 1)
    return F.lower(F.coalesce(F.nullif(from_tag, F.lit("")), F.nullif(from_meta, F.lit(""))))


def title(html) -> Column:
    return T.strip(T.unescape_html(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def body_text(html) -> Column:
    h = _c(html)
    art = F.regexp_extract(h, r"(?is)<article[^>]*>(.*?)(?:</article>|\z)", 1)
    body = F.regexp_extract(h, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)
    b = F.when(F.regexp_like(h, F.lit(r"(?i)<article")), art).otherwise(body)
    b = F.regexp_replace(b, r"(?is)<script[^>]*>.*?</script>", "")
    b = F.regexp_replace(b, r"(?is)<style[^>]*>.*?</style>", "")
    b = F.regexp_replace(b, r"(?is)<h1[^>]*>.*?</h1>", "")
    b = F.regexp_replace(b, r"(?is)<!--.*?-->", "")
    b = F.regexp_replace(b, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[2-6]|blockquote)(?:\s[^>]*)?>", "\n")
    b = F.regexp_replace(b, r"<[^>]*>", "")
    b = T.unescape_html(b)
    return T.strip(T.collapse_newlines(b))


def authors(html) -> Column:
    vals = F.regexp_extract_all(_c(html), F.lit(r'(?is)<meta[^>]*?name\s*=\s*"author"[^>]*?content\s*=\s*"([^"]*)"'), F.lit(1))
    return F.filter(F.transform(vals, lambda x: T.unescape_html(x)), lambda x: T.short_author(x))


def publish_date(html) -> Column:
    h = _c(html)
    raw = F.coalesce(*[F.nullif(meta_content(h, n), F.lit("")) for n in ("article:published_time", "date", "pubdate")])
    return F.date_format(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")), "MM-dd-yyyy")


def summary(html) -> Column:
    h = _c(html)
    return T.pick_summary(meta_content(h, "og:description"), meta_content(h, "twitter:description"),
                          meta_content(h, "description"))
