"""Column expressions for text cleaning.  All are Catalyst expressions (codegen, no Python).

Regex dialect notes: Spark uses java.util.regex.  Python's ``\\s`` is Unicode-aware and its
``.`` stops only at ``\\n``; we spell the whitespace class out (``WS``) and prefix patterns with
``(?d)`` (UNIX_LINES) so that both behave exactly like the Python originals.  The same class is
valid in RE2, so the DuckDB oracles use the identical pattern text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed

# Python's str.isspace() set, written so that Java and RE2 read it identically.
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ws_pattern(pattern: str) -> str:
    """Rewrite ``\\s`` (outside classes) to the Unicode whitespace class and pin ``.`` to ``\\n``."""
    return "(?d)" + pattern.replace(r"\s", WS)


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+\\z", "")


def lstrip_newlines(col) -> Column:
    return F.regexp_replace(_c(col), "^\n+", "")


def collapse_newlines(col) -> Column:
    """A newline followed by any whitespace becomes a single newline."""
    return F.regexp_replace(_c(col), f"\n{WS}+", "\n")


def squeeze_newlines(col) -> Column:
    """Runs of newlines become one."""
    return F.regexp_replace(_c(col), "\n+", "\n")


def unescape_html(col) -> Column:
    """Decode the common named and numeric entities (``&amp;`` last)."""
    c = _c(col)
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
                    ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def cut_leading_title(text, title) -> Column:
    """If text starts with title + newline, drop the title and the newlines after it."""
    t, ti = _c(text), _c(title)
    starts = F.startswith(t, F.concat(ti, F.lit("\n")))
    return F.when(starts, lstrip_newlines(F.substring(t, F.length(ti) + 1, 1 << 30))).otherwise(t)


def strip_boilerplate_text(col, rules=None) -> Column:
    """P11 + P12: append a newline, apply the ordered substitutions, squeeze newline runs.

    The trailing newline stays (the original discards its ``strip()`` result, quirk X4).
    """
    rules = fixed.BOILERPLATE_RULES if rules is None else rules
    c = F.concat(_c(col), F.lit("\n"))
    c = reduce(lambda acc, r: F.regexp_replace(acc, ws_pattern(r[0]), r[1]), rules, c)
    return squeeze_newlines(c)


def undouble_names(text, domain, names=None, on_domain=None) -> Column:
    """On one domain, "X X" becomes "X" for each listed company name, in order."""
    names = fixed.DOUBLED_NAMES if names is None else names
    on_domain = fixed.DOUBLED_NAME_DOMAIN if on_domain is None else on_domain
    t = _c(text)
    fixed_t = reduce(lambda acc, n: F.replace(acc, F.lit(f"{n} {n}"), F.lit(n)), names, t)
    return F.when(_c(domain) == F.lit(on_domain), fixed_t).otherwise(t)


def plausible_author(x: Column) -> Column:
    """F15 predicate on one author string."""
    low = strip(F.lower(x))
    bad_prefix = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in fixed.AUTHOR_BAD_PREFIXES])
    return ~bad_prefix & ~F.contains(low, F.lit(fixed.AUTHOR_BAD_INFIX)) & ~low.isin(fixed.AUTHOR_BAD_WORDS)


def short_author(x: Column, max_words: int = fixed.MAX_AUTHOR_WORDS) -> Column:
    """F16: fewer than ``max_words`` space-separated words (Python ``split(' ')`` semantics)."""
    return F.size(F.split(x, " ", -1)) < max_words


def pick_summary(*cols, min_len: int = fixed.MIN_SUMMARY_LENGTH) -> Column:
    """First candidate whose stripped length exceeds ``min_len``."""
    cands = [F.when(F.length(strip(_c(c))) > min_len, strip(_c(c))) for c in cols]
    return F.coalesce(*cands)


def summary_or_null(col) -> Column:
    """P10: summaries ending in an ellipsis are teasers, not summaries."""
    c = _c(col)
    ends = reduce(lambda a, b: a | b, [F.endswith(c, F.lit(e)) for e in fixed.SUMMARY_BAD_ENDINGS])
    return F.when(ends, F.lit(None).cast("string")).otherwise(c)


def content_key(col, n: int = fixed.CONTENT_LENGTH, end: bool = False) -> Column:
    """First (or last) ``n`` characters of the cleaned text."""
    c = _c(col)
    return F.right(c, F.lit(n)) if end else F.substring(c, 1, n)


def gallery_count(col) -> Column:
    return F.regexp_count(_c(col), F.lit(fixed.GALLERY_PATTERN))


def mm_dd_yyyy(col) -> Column:
    """P5: a date/timestamp (or parseable string) rendered as MM-dd-yyyy; non-dates become null."""
    c = _c(col)
    return F.date_format(F.try_to_timestamp(c.cast("string")), "MM-dd-yyyy")


def spelled_date(col) -> Column:
    """``MM-dd-yyyy`` -> ``Month dd, yyyy``; day and year are copied verbatim."""
    parts = F.split(_c(col), "-", -1)
    month = F.element_at(F.array(*[F.lit(m) for m in fixed.MONTHS]), parts.getItem(0).cast("int"))
    return F.concat(month, F.lit(" "), parts.getItem(1), F.lit(", "), parts.getItem(2))


def valid_date(col) -> Column:
    """a ``MM-dd-yyyy`` string has three parts and a numeric month."""
    parts = F.split(_c(col), "-", -1)
    return F.coalesce((F.size(parts) == 3) & F.regexp_like(parts.getItem(0), F.lit(r"^[0-9]+$")), F.lit(False))


def authors_text(col, min_len: int = fixed.MIN_AUTHORS_LENGTH) -> Column:
    """Authors joined with ', ', used only when longer than ``min_len`` characters."""
    joined = F.concat_ws(", ", _c(col))
    return F.when(F.length(joined) > min_len, joined)


def summary_text(col, min_len: int = fixed.MIN_PIECE_SUMMARY_LENGTH) -> Column:
    """A summary is used as a field only when longer than ``min_len`` characters."""
    c = _c(col)
    return F.when(F.length(c) > min_len, c)
