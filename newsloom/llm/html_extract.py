"""HTML extraction by equivalence-class template deduction.

1. occurrence vectors: every element path (tags with classes and ids) and every text run is a token; for each host a
   token's vector of counts over the host's pages is kept as (pages, occurrences, two sums of 32-bit hashes of
   (page, count)), which merge in any order, so a host with a third of all pages is combined before the shuffle;
2. classes: tokens of a host with equal vectors form an equivalence class.  A class is valid when it covers SUPPORT of
   the host's pages and either occurs once on each or has several tokens; a text run is valid when it stands on
   RUN_SUPPORT of the pages (fixed text).  Valid element tokens nest by their paths into the host's template: one whose
   parent isn't in the template isn't either;
3. slots: a text run belongs to the slot of its innermost template element.  Slots of menus, headers, footers, sidebars,
   notices, adverts, forms and comments are furniture; where the template has an article or main element, only slots within
   it are content.  Fixed text leaves the content unless it is half of it or more by characters, as on hosts of near copies.

An element is furniture by its name, or by a furniture word in its class, id or role.  The words are a hint: html and body
never take it, article and main only from a whole class name, headings and text blocks not from their id, and the first
article or main voids what its ancestors took from a part of a class name (``has-sidebar``).

Hosts with fewer than MIN_PAGES pages have no template; their pages use the same slot rules on their own elements.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch, cut_lineage, map_arrow, pylist, table

MIN_PAGES = 3
SUPPORT = 0.9
RUN_MIN_PAGES = 10
RUN_SUPPORT = 0.8
TALLY = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?=>)|[^>]*)>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)
_TEXT = re.compile(r"()()()()(.+)", re.S)          # text where _TOKEN has it
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr del link meta hr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("head nav footer aside form menu dialog button fieldset".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
                   "breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup "
                   "login comment comments discussion disqus reply replies respond footer header masthead share sharing social related recommended "
                   "pagination pager widget toolbar search complementary contentinfo navigation".split())
_INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo share sharing social".split())
_NO_ID_HINT = frozenset("h1 h2 h3 h4 h5 h6 p li td th dt dd pre blockquote figure figcaption".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = frozenset("ul ol table dl article section main div body nav aside footer header blockquote".split())
_BLOCK_ENDS_P = frozenset("article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol pre section table ul".split())


def _matches(source: str) -> Iterator[re.Match]:
    """Matches of _TOKEN in time linear in the page: a tag's attributes are read one way only (up to the first ``>`` if
    their quotes don't close), and tags are looked for only up to the last ``>``; what follows is text."""
    last, m = source.rfind(">") + 1, None
    for m in _TOKEN.finditer(source, 0, last):
        yield m
    if m is not None and (m[0].startswith("<!--") and not m[0].endswith("-->")
                          or m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)):
        return          # the rest lies in an open comment or element
    yield from _TEXT.finditer(source[last:].partition("<!--")[0])


def _element(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(token name of an element, whether it is furniture, whether only by a part of a class, id or role name)."""
    certain, hint = tag in _FURNITURE, False
    if not attrs.strip():
        return tag, certain, False
    names = []
    for key, *values in _ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = next((v for v in values if v), "").lower()
        if key in ("hidden", "aria-hidden"):
            certain = certain or key == "hidden" or value == "true"
            continue
        names.append(re.sub(r"[0-9]+", "0", value))
        if tag in ("html", "body") or key == "id" and tag in _NO_ID_HINT:
            continue
        certain = certain or not _WORDS.isdisjoint(value.split())
        hint = hint or tag not in ("article", "main") and not _WORDS.isdisjoint(re.split(r"[^a-z]+", value))
    return ".".join([tag, *sorted(names)]), certain or hint, hint and not certain


def _inline_furniture(attrs: str) -> bool:
    """Whether a class of an inline element is one of an advert or of share links."""
    return any(key.lower() == "class" and not _INLINE_WORDS.isdisjoint("".join(values).lower().split()) for key, *values in _ATTR.findall(attrs))


def parse(source: str) -> list[tuple[int, tuple[int, ...], bool, bool, str]]:
    """Text runs in page order: (block, ancestor token hashes from the root, furniture, inside article or main, raw text).
    Element tokens without text are also listed, with an empty text."""
    runs = []
    path, hashes, off, within = [""], [()], [False], [False]
    tags, sure = [""], [False]
    block, rooted = 0, False
    skipped, depth = "", 0          # the inline advert or share link that is open

    def pop(to: int) -> None:
        del path[to:], hashes[to:], off[to:], within[to:], tags[to:], sure[to:]

    for m in _matches(source):
        raw, close, tag, attrs, text = m.group(1), m.group(2), m.group(3), m.group(4), m.group(5)
        if text is not None:
            if skipped:
                continue
            runs.append((block, hashes[-1], off[-1], within[-1], text))
            continue
        if raw is not None or tag is None:
            if raw is not None:
                block += raw.lower() not in _INLINE
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if skipped:
                depth += (tag == skipped) * (-1 if close else 1)
                skipped = skipped if depth else ""
                continue
            if not close and tag not in _VOID and "class" in attrs.lower() and _inline_furniture(attrs):
                skipped, depth = tag, 1
                continue
            if tag in ("br", "wbr", "hr"):
                runs.append((block, hashes[-1], off[-1], within[-1], " "))
                block += tag == "hr"
            continue
        skipped, depth = "", 0
        block += 1
        if close:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == tag:
                    pop(k)
                    break
            continue
        if tag in _VOID:
            continue
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCK_ENDS_P else set())
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in ends:
                pop(k)
                break
            if tags[k] in _SCOPES:
                break
        name, furniture, hint = _element(tag, attrs)
        if tag == "header" and not within[-1]:
            furniture, hint = True, False
        root = tag in ("article", "main") or ".main" in name
        if tag in ("article", "main") and not rooted and not furniture:
            # the first article or main: its ancestors are furniture only if one is by more than a hint
            if off[-1] and not sure[-1]:
                off[:] = [False] * len(off)
            rooted = not off[-1]
        path.append(path[-1] + "/" + name)
        hashes.append((*hashes[-1], xxhash.xxh64_intdigest(path[-1]) - 2**63))
        off.append(off[-1] or furniture)
        sure.append(sure[-1] or furniture and not hint)
        within.append(within[-1] or root)
        tags.append(tag)
        runs.append((block, hashes[-1], off[-1], within[-1], ""))
    return runs


def clean(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def _run_token(hashes: tuple[int, ...], text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=(hashes[-1] if hashes else 0) % 2**63) - 2**63


def blocks_of(runs: list) -> list[tuple[tuple[int, ...], bool, bool, str]]:
    """Non-empty blocks in page order: (ancestors, furniture, inside article, text with single spaces)."""
    out, at, held, flags = [], None, [], (False, False)
    for block, hashes, off, within, text in [*runs, (-1, (), False, False, "")]:
        if (block, hashes) != at:
            joined = clean("".join(held))
            if joined:
                out.append((at[1], *flags, joined))
            at, held, flags = (block, hashes), [], (off, within)
        held.append(text)
    return out


def occurrences(runs: list) -> tuple[dict[int, int], dict[int, int], set[int]]:
    """Counts of a page's element tokens and text-run tokens, and the article and main tokens among them."""
    elements: dict[int, int] = {}
    texts: dict[int, int] = {}
    content = set()
    for _, hashes, off, within, text in runs:
        if not text and hashes:
            elements[hashes[-1]] = elements.get(hashes[-1], 0) + 1
            if within and not off:
                content.add(hashes[-1])
    for hashes, _, _, text in blocks_of(runs):
        t = _run_token(hashes, text)
        texts[t] = texts.get(t, 0) + 1
    return elements, texts, content


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def templates(data: DataFrame) -> DataFrame:
    """(host, elements, content, fixed): the template of every host with enough pages, as arrays of token hashes."""
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.int32()), ("pages", pa.int64()),
                        ("total", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def sent():
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return batch(schema, dict(zip(schema.names, map(list, zip(*rows)))))

        for b in batches:
            for host, row, source in zip(pylist(b, "host"), pylist(b, "row"), pylist(b, "data")):
                elements, texts, content = occurrences(parse(source.decode("utf-8", "replace")))
                marks = [(0, 0, 1)]           # the page itself
                marks += [(t, 2 if t in content else 1, n) for t, n in elements.items()]
                marks += [(t, 3, n) for t, n in texts.items()]
                for token, kind, n in marks:
                    e = held.setdefault((host, token, kind), [0, 0, 0, 0])
                    e[0] += 1
                    e[1] += n
                    x = xxhash.xxh64_intdigest(b"%d %d" % (row, n))
                    e[2] += x & 0xFFFFFFFF
                    e[3] += x >> 32
                if len(held) > TALLY:
                    yield sent()
        if held:
            yield sent()

    vectors = (map_arrow(data, run, "host string, token long, kind int, pages long, total long, low long, high long")
               .groupBy("host", "token", "kind").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("low").alias("low"), F.sum("high").alias("high")))
    # tokens on fewer pages than any support needs are dropped before the classes are formed
    often = cut_lineage(vectors.where((F.col("pages") >= MIN_PAGES) & ((F.col("kind") != 3) | (F.col("pages") >= RUN_MIN_PAGES))))
    sizes = often.where("kind = 0").select("host", F.col("pages").alias("host_pages"))
    placed = often.where("kind > 0").join(sizes, "host").where(F.col("pages") >= F.when(F.col("kind") == 3, RUN_SUPPORT).otherwise(SUPPORT) * F.col("host_pages"))
    classes = placed.groupBy("host", "pages", "low", "high").agg(
        F.collect_list(F.struct("token", "kind", "total")).alias("members"))
    valid = (classes.select("host", "pages", F.size("members").alias("n"), F.explode("members").alias("m"))
             .where((F.col("m.kind") == 3) | (F.col("n") > 1) | (F.col("m.total") == F.col("pages"))))

    def of(kind):
        return F.collect_list(F.when(kind, F.col("m.token")))

    return valid.groupBy("host").agg(of(F.col("m.kind") < 3).alias("elements"), of(F.col("m.kind") == 2).alias("content"),
                                     of(F.col("m.kind") == 3).alias("fixed"))


def main_text(source: str, elements: set[int], content: set[int], fixed: set[int]) -> str:
    """Text of the slots that are neither furniture nor fixed; blocks joined by two line breaks."""
    runs = parse(source)
    blocks = blocks_of(runs)
    if content:
        # the slot of a block: its innermost template element; content slots only
        chosen = [x for x in blocks if not x[1] and any(h in content for h in takewhile(elements.__contains__, x[0]))]
    else:
        chosen = []
    if not chosen:
        chosen = [x for x in blocks if not x[1] and x[2]] or [x for x in blocks if not x[1]]
    free = [x for x in chosen if _run_token(x[0], x[3]) not in fixed]
    if 2 * sum(len(x[3]) for x in free) <= sum(len(x[3]) for x in chosen):
        free = chosen          # most of the content is fixed: near copies of one page
    return "\n\n".join(x[3] for x in free)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text.

    Null or empty html gives the empty text; a null or malformed url belongs to the host '' ; repeated pages count as
    pages, in every vector alike, and are each returned; very long pages are read whole; broken markup is closed as browsers do.
    """
    data = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        host_of(F.col(url_col).cast("string")).alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("data"))
    marked = data.select("host", "data", F.xxhash64("page_id", "url").alias("row"))
    # written, so that the planner knows the size of the templates: it broadcasts a small table and then leaves the pages
    # where they are, and joins by a shuffle (with skewed hosts split) otherwise
    joined = data.join(cut_lineage(templates(marked)), "host", "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for b in batches:
            out = []
            columns = [pylist(b, c) for c in ("host", "data")]
            template = [b.column(b.schema.get_field_index(c)) for c in ("elements", "content", "fixed")]
            for k, (host, source) in enumerate(zip(*columns)):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = [set(t[k].as_py() or ()) for t in template]
                out.append(main_text(source.decode("utf-8", "replace"), *sets[host]))
            yield batch(schema, {"page_id": b.column(b.schema.get_field_index("page_id")), "url": b.column(b.schema.get_field_index("url")), "text": out})

    return map_arrow(joined.select("page_id", "url", "host", "data", "elements", "content", "fixed"), run, "page_id long, url string, text string")


def op3_html_extract(spark, sf_dir):
    """Main text of all pages by template deduction (see module)."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLES: dict[str, str] = {}
