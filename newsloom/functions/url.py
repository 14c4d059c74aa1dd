"""URL expressions: canonical form, host, path extension, registered domain.

The registered-domain split uses a suffix list known when the plan is built, so it compiles to
``InSet`` hash lookups per candidate depth -- no join, no shuffle, codegen friendly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"

# Generic public suffixes used when the caller gives none (configuration, not a fixed value).
DEFAULT_SUFFIXES = ["com", "net", "org", "edu", "gov", "info", "io", "co", "ca", "fi", "ir", "pe",
                    "uk", "co.uk", "org.uk", "com.pe", "com.au", "au", "de", "fr", "es", "us"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical(url) -> Column:
    """Drop query and fragment; keep scheme, host, path and params."""
    return F.regexp_replace(_c(url), r"(?s)[?#].*$", "")


def host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url) -> Column:
    return F.regexp_extract(_c(url), _SCHEME + r"[^/?#]*([^?#]*)", 1)


def extension(url) -> Column:
    """Extension of the last path segment, without the dot, lower-cased ('' if none).

    Follows ``os.path.splitext`` on the basename: leading dots do not start an extension.
    """
    base = F.regexp_extract(path(url), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*\.([^.]*)$", 1))


def ending_count(url) -> Column:
    """occurrences of .com/.co.uk/.net/.org anywhere in the URL."""
    return F.regexp_count(_c(url), F.lit(fixed.URL_ENDINGS_PATTERN))


def banned_pattern(strings=None) -> str:
    strings = fixed.BANNED_STRINGS if strings is None else strings
    return "(" + "|".join(re.escape(s) for s in strings) + ")"


def has_banned_string(url, strings=None) -> Column:
    """one compiled alternation over the escaped banned substrings."""
    return F.regexp_like(_c(url), F.lit(banned_pattern(strings)))


def split_domain(host_col, suffixes=None) -> tuple[Column, Column, Column]:
    """(registered domain, subdomain, suffix) by longest suffix match.

    Returns nulls when no suffix matches.
    """
    suffixes = DEFAULT_SUFFIXES if suffixes is None else suffixes
    by_depth: dict[int, list[str]] = {}
    for s in suffixes:
        by_depth.setdefault(s.count(".") + 1, []).append(s.lower())
    labels = F.split(_c(host_col), r"\.", -1)
    n = F.size(labels)
    depth = F.lit(None).cast("int")
    for d in sorted(by_depth):            # deepest match wins: later whens overwrite
        cand = F.array_join(F.slice(labels, -d, d), ".")
        depth = F.when((n > d) & cand.isin(by_depth[d]), F.lit(d)).otherwise(depth)
    suffix = F.array_join(F.slice(labels, -depth, depth), ".")
    domain = F.concat(F.element_at(labels, -(depth + 1)), F.lit("."), suffix)
    sub = F.when(n - depth - 1 > 0, F.array_join(F.slice(labels, 1, n - depth - 1), ".")).otherwise(F.lit(""))
    return (F.when(depth.isNotNull(), domain), F.when(depth.isNotNull(), sub), F.when(depth.isNotNull(), suffix))
