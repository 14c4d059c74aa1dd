"""DuckDB SQL text for the oracle queries (the independent check of each Spark plan).

These build plain SQL strings; they mirror the *definitions* of the operators, written in
DuckDB's dialect (RE2 regexes with the 'g' flag, ``chr(10)`` for newlines, 1-based lists).
"""

from __future__ import annotations

import re

from newsloom.functions import fixed
from newsloom.functions.text import WS
from newsloom.functions.url import DEFAULT_SUFFIXES

NL = "chr(10)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, repl_sql: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {repl_sql}, 'g')"


def strip(x: str) -> str:
    return rx_replace(x, f"^{WS}+|{WS}+\\z")


def unescape(x: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
                    ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def collapse_newlines(x: str) -> str:
    return rx_replace(x, f"\\n{WS}+", NL)


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, {q(SCHEME + r'(?:[^/?#@]*@)?([^/?#:]*)')}, 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, {q(SCHEME + r'[^/?#]*([^?#]*)')}, 1)"


def extension(url: str) -> str:
    base = f"regexp_extract({path(url)}, '([^/]*)$', 1)"
    return f"lower(regexp_extract({base}, {q(r'^\.*[^.].*\.([^.]*)$')}, 1))"


def canonical(url: str) -> str:
    return rx_replace(url, r"(?s)[?#].*$")


def banned_pattern() -> str:
    return "(" + "|".join(re.escape(s) for s in fixed.BANNED_STRINGS) + ")"


def ending_count(url: str) -> str:
    return f"len(regexp_extract_all({url}, {q(fixed.URL_ENDINGS_PATTERN)}))"


def depth_case(labels: str, n: str, suffixes=None) -> str:
    suffixes = DEFAULT_SUFFIXES if suffixes is None else suffixes
    by_depth: dict[int, list[str]] = {}
    for s in suffixes:
        by_depth.setdefault(s.count(".") + 1, []).append(s.lower())
    whens = []
    for d in sorted(by_depth, reverse=True):
        cand = f"array_to_string({labels}[{n}-{d}+1:{n}], '.')"
        lst = ", ".join(q(s) for s in by_depth[d])
        whens.append(f"WHEN {n} > {d} AND {cand} IN ({lst}) THEN {d}")
    return "CASE " + " ".join(whens) + " END"


def html_title(h: str) -> str:
    return strip(unescape(f"regexp_extract({h}, {q(r'(?is)<title[^>]*>(.*?)</title>')}, 1)"))


def html_lang(h: str) -> str:
    tag = f"regexp_extract({h}, {q(r'(?is)<html[^>]*?\slang\s*=\s*\"([A-Za-z]+)')}, 1)"
    meta = (f"regexp_extract({h}, {q(r'(?is)<meta[^>]*?http-equiv\s*=\s*\"content-language\"[^>]*?content\s*=\s*\"([A-Za-z]+)')}, 1)")
    return f"lower(coalesce(nullif({tag}, ''), nullif({meta}, '')))"


def html_body(h: str) -> str:
    art = f"regexp_extract({h}, {q(r'(?is)<article[^>]*>(.*?)(?:</article>|\z)')}, 1)"
    body = f"regexp_extract({h}, {q(r'(?is)<body[^>]*>(.*?)(?:</body>|\z)')}, 1)"
    b = f"(CASE WHEN regexp_matches({h}, '(?i)<article') THEN {art} ELSE {body} END)"
    b = rx_replace(b, r"(?is)<script[^>]*>.*?</script>")
    b = rx_replace(b, r"(?is)<style[^>]*>.*?</style>")
    b = rx_replace(b, r"(?is)<h1[^>]*>.*?</h1>")
    b = rx_replace(b, r"(?is)<!--.*?-->")
    b = rx_replace(b, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[2-6]|blockquote)(?:\s[^>]*)?>", NL)
    b = rx_replace(b, r"<[^>]*>")
    return strip(collapse_newlines(unescape(b)))


def cut_leading_title(t: str, title: str) -> str:
    return (f"(CASE WHEN starts_with({t}, {title} || {NL}) "
            f"THEN regexp_replace(substring({t}, length({title}) + 1), '^\\n+', '') ELSE {t} END)")


def boilerplate(t: str) -> str:
    x = f"({t} || {NL})"
    for pat, rep in fixed.BOILERPLATE_RULES:
        p = pat.replace(r"\s", WS)
        rep_sql = "''" if rep == "" else (" || ".join(
            [q(seg) if seg != "\n" else NL for seg in re.split(r"(\n)", rep) if seg != ""]))
        x = rx_replace(x, p, rep_sql)
    return rx_replace(x, r"\n+", NL)


def uniform(seed, salt, *keys: str) -> str:
    parts = " || '|' || ".join([q(str(seed)), q(str(salt))] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0)"
